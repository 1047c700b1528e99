"""Media, toxicity and mixing against straightforward loops."""

import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest

from quillon.llm import media_jpeg, pfair_mix, registry, toxicity

from test_llm_operators import AWKWARD, documents


# --- a scalar decoder of progressive JPEG, written from the format's description -----------------


class Bits:
    def __init__(self, data):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff"), 0

    def one(self):
        byte, bit = divmod(self.at, 8)
        self.at += 1
        return self.data[byte] >> (7 - bit) & 1 if byte < len(self.data) else 1

    def many(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | self.one()
        return v

    def symbol(self, table):
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.one()
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")


def signed(v, n):
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


def scalar_decode(f):
    """(quantisers, components as (horizontal, vertical, blocks by row, columns)) with coefficients in zigzag order."""
    assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
    i, tables, quant, restart, comps = 2, {}, {}, 0, {}
    while f[i : i + 2] != b"\xff\xd9":
        mark, size = f[i + 1], struct.unpack(">H", f[i + 2 : i + 4])[0]
        body, i = f[i + 4 : i + 2 + size], i + 2 + size
        if mark == 0xDB:
            while body:
                quant[body[0] & 15], body = list(body[1:65]), body[65:]
        elif mark == 0xC4:
            while body:
                counts, symbols, code, k, table = body[1:17], body[17:], 0, 0, {}
                for length, n in enumerate(counts, 1):
                    for s in symbols[k : k + n]:
                        table[length, code] = s
                        code += 1
                    k += n
                    code <<= 1
                tables[body[0]], body = table, body[17 + k :]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xC2:
            _, high, wide, n = struct.unpack(">BHHB", body[:6])
            most = [max(body[7 + 3 * c] >> s & 15 for c in range(n)) for s in (4, 0)]
            units = (-(-wide // (8 * most[0])), -(-high // (8 * most[1])))
            for c in range(n):
                ident, hv, q = body[6 + 3 * c : 9 + 3 * c]
                h, v = hv >> 4, hv & 15
                cols, rows = units[0] * h, units[1] * v
                comps[ident] = {"h": h, "v": v, "q": q, "cols": cols, "rows": rows, "b": np.zeros((rows * cols, 64), np.int64), "own": (-(-wide * h // (8 * most[0])), -(-high * v // (8 * most[1])))}
        elif mark == 0xDA:
            n = body[0]
            chosen = [(comps[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(n)]
            lo, hi, ahl = body[1 + 2 * n : 4 + 2 * n]
            ah, al = ahl >> 4, ahl & 15
            end = i
            while not (f[end] == 0xFF and f[end + 1] not in (0, *range(0xD0, 0xD8))):
                end += 1
            parts, last = [], i
            for j in range(i, end - 1):
                if f[j] == 0xFF and 0xD0 <= f[j + 1] < 0xD8:
                    parts.append(f[last:j])
                    last = j + 2
            parts.append(f[last:end])
            i = end
            if n > 1:
                order = [[(c, t, (y * c["v"] + dy) * c["cols"] + x * c["h"] + dx) for c, t in chosen for dy in range(c["v"]) for dx in range(c["h"])] for y in range(units[1]) for x in range(units[0])]
            else:
                c, t = chosen[0]
                order = [[(c, t, y * c["cols"] + x)] for y in range(c["own"][1]) for x in range(c["own"][0])]
            step = restart or len(order)
            for part, lot in zip(parts, itertools.batched(order, step), strict=True):
                scan(Bits(part), lot, tables, lo, hi, ah, al)
    return quant, comps


def scan(bits, units, tables, lo, hi, ah, al):
    before, run = {}, 0
    for c, t, at in itertools.chain.from_iterable(units):
        b = c["b"][at]
        if lo == 0:
            if ah:
                b[0] |= bits.one() << al
            else:
                n = bits.symbol(tables[t >> 4])
                before[id(c)] = before.get(id(c), 0) + signed(bits.many(n), n)
                b[0] = before[id(c)] << al
            continue
        k = lo
        if ah == 0:
            if run:
                run -= 1
                continue
            while k <= hi:
                r, n = divmod(bits.symbol(tables[16 | t & 15]), 16)
                if n == 0 and r < 15:
                    run = (1 << r) + bits.many(r) - 1
                    break
                k += r
                if n:
                    b[k] = signed(bits.many(n), n) * (1 << al)
                k += 1
            continue

        def correct(j):
            if bits.one() and not abs(b[j]) & 1 << al:
                b[j] += (1 << al) if b[j] > 0 else -(1 << al)

        if not run:
            while k <= hi:
                r, n = divmod(bits.symbol(tables[16 | t & 15]), 16)
                new = 0
                if n == 0 and r < 15:
                    run = (1 << r) + bits.many(r)
                    break
                if n:
                    new = (1 << al) if bits.one() else -(1 << al)
                while k <= hi:
                    if b[k]:
                        correct(k)
                    elif r == 0:
                        b[k] = new
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
        if run:
            for j in range(k, hi + 1):
                if b[j]:
                    correct(j)
            run -= 1


def test_files_decode_by_the_format_alone():
    rng = random.Random(3)
    loads = [media_jpeg.payload_bytes(x) for x in (b"", b"plain words " * 90, bytes(rng.randrange(256) for _ in range(1500)))]
    files = media_jpeg.encode(loads)
    z, _, _ = media_jpeg.coefficients(files)
    first = 0
    for f, rgb in zip(files, media_jpeg.decode_rgb(files)):
        quant, comps = scalar_decode(f)
        assert all(set(q) == {1} for q in quant.values())
        mine = np.concatenate([c["b"] for c in comps.values()])
        assert (mine == z[first : first + len(mine)]).all()
        first += len(mine)
        planes = []
        for c in comps.values():
            plane = np.zeros((c["rows"] * 8, c["cols"] * 8))
            for at in range(len(c["b"])) if len(c["b"]) < 30 else (0, len(c["b"]) - 1):
                y0, x0 = at // c["cols"] * 8, at % c["cols"] * 8
                for y in range(8):
                    for x in range(8):
                        s = 0.0
                        for k, (v, u) in enumerate(divmod(int(p), 8) for p in media_jpeg.ZIGZAG):
                            if c["b"][at, k]:
                                s += (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * c["b"][at, k] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
                        plane[y0 + y, x0 + x] = min(255, max(0, round(s / 4 + 128)))
            planes.append(plane)
        y, cb, cr = planes[0], *(np.repeat(np.repeat(p, 2, 0), 2, 1) for p in planes[1:])
        for py, px in ((0, 0), (3, 5), (7, 7)):
            a, b, c = y[py, px], cb[py, px] - 128, cr[py, px] - 128
            want = (a + 1.402 * c, a - 0.344136 * b - 0.714136 * c, a + 1.772 * b)
            assert all(abs(int(g) - min(255, max(0, w))) <= 2 for g, w in zip(rgb[py, px], want))
    assert first == len(z)


def test_media_digests_are_those_of_the_payload(spark):
    texts = [*AWKWARD, "again", "again"]
    stored = media_jpeg.stored_media(documents(spark, texts))
    media = {r.doc_id: bytes(r.media) for r in stored.select("doc_id", "media").collect()}
    for r in media_jpeg.media_digests(stored).collect():
        raw = (texts[r.doc_id] or "").encode()
        load = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(load), len(media[r.doc_id]))
        assert r.payload_sha256 == hashlib.sha256(load).hexdigest() and r.tail_crc32 == zlib.crc32(load[-32:])
        assert r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest()


# --- toxicity ------------------------------------------------------------------------------------


def test_trees_and_calibration_are_the_loops():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = (x[:, 1] + 0.5 * x[:, 2] + rng.normal(size=400) > 0.3).astype(float)
    cx, cy = x[:150] + 0.05, y[:150]
    m = toxicity.fit_trees(x, y, cx, cy, rounds=4, depth=3)

    def walk(row):
        out = m.prior
        for feature, threshold, value in m.trees:
            k = 0
            while k < len(feature) and feature[k] >= 0:
                k = 2 * k + 1 + (row[feature[k]] > threshold[k])
            out += value[k]
        return out

    margins = [walk(r) for r in cx]
    assert np.allclose(m.margin(cx), margins)
    # the first split is the best of all by the second-order gain
    share = y.mean()
    g, h = share - y, np.full(400, share * (1 - share))
    best = (0, None)
    for j in range(4):
        for t in sorted(set(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1]))):
            left = x[:, j] <= t
            if h[left].sum() >= 0.5 and h[~left].sum() >= 0.5:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (round(gain, 9), (j, t)), key=lambda b: b[0])
    assert (m.trees[0][0][0], m.trees[0][1][0]) == best[1]
    # isotonic values: the largest, over where a stretch begins, of the least mean over where it ends
    order = np.argsort(margins, kind="stable")
    ys = cy[order]
    want = [max(min(ys[a : b + 1].mean() for b in range(i, len(ys))) for a in range(i + 1)) for i in range(len(ys))]
    steps = [k for k, _ in itertools.groupby(np.round(want, 9))]
    xs, vs = toxicity.isotonic(np.array(margins), cy)
    assert [k for k, _ in itertools.groupby(np.round(vs, 9))] == steps and (np.diff(vs) >= 0).all() and (np.diff(xs) >= 0).all()


def test_held_out_toxic_texts_are_told_apart(spark, sf):
    whole = sf.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{whole}/labels.parquet").where("toxic is not null").collect()}
    got = [(r.score, r.predicted, labels[r.doc_id]) for r in registry.op7_toxicity(spark, whole).where("held_out").select("doc_id", "score", "predicted").collect() if r.doc_id in labels]
    toxic, clean = [s for s, _, y in got if y], [s for s, _, y in got if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.95 and len(toxic) > 20
    assert sum(p for _, p, y in got if not y) <= 0.02 * len(clean)


# --- mixing --------------------------------------------------------------------------------------


def by_earliest_deadline(rows, weights, size):
    """(id, source, block, place, slot, release, deadline) by choosing slot after slot."""
    key = lambda s: "n" if s is None else f"s{s}"
    of = {}
    for i, s in rows:
        of.setdefault(s, []).append(i)
    names = sorted(of, key=key)
    blocks = {s: [sorted(of[s])[k : k + size] for k in range(0, len(of[s]), size)] for s in names}
    done, out, slot = dict.fromkeys(names, 0), [], 0
    while any(done[s] < len(blocks[s]) for s in names):
        live = [s for s in names if done[s] < len(blocks[s])]
        total, own, base = sum(weights.get(s, 1) for s in live), dict.fromkeys(live, 0), slot
        while all(done[s] < len(blocks[s]) for s in live):
            ready = []
            for k, s in enumerate(live):
                w = weights.get(s, 1)
                if own[s] * total // w <= slot - base:
                    ready.append((-(-(own[s] + 1) * total // w), k, s, own[s] * total // w))
            deadline, _, s, release = min(ready)
            out += [(i, s, done[s], p, slot, base + release, base + deadline) for p, i in enumerate(blocks[s][done[s]])]
            own[s] += 1
            done[s] += 1
            slot += 1
    return out


@pytest.mark.parametrize("size", [1, 3])
def test_rows_stand_where_the_loop_puts_them(spark, size):
    rng = random.Random(size)
    rows = [(i, rng.choice([None, "a", "b", "b", "c", "c", "c", "c"])) for i in range(160)] + [(999, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    weights = {"a": 5, "b": 2, "c": 1, None: 3}
    got = pfair_mix.mixed(df, weights, size).select("doc_id", "source", "block", "place", "slot", "release", "deadline").collect()
    assert sorted(map(tuple, got), key=str) == sorted(by_earliest_deadline(rows, weights, size), key=str)
    for n in range(1, max(r.slot for r in got) + 2):  # at any slot before the first source ends, each has its share to within a block
        first = {s: len({r.block for r in got if r.source == s and r.slot < n}) for s in (None, "a", "b", "c", "tiny")}
        if first["tiny"] == 1:
            break
        assert all(abs(k - n * weights.get(s, 1) / 12) < 1 for s, k in first.items())
