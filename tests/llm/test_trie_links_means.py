"""Conversation trie, URL trust and sort-means against brute force, in pieces so small that every carry and level is used."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import _util as U
from quillon.llm import conversation_trie, registry, running, sort_means, url_trust

TURNS = "conv_id long, turn long, role string, text string, depth long, sym string, rank long, k1 long, one long"


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t))


def trie_brute(rows, family=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    told = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(np.fmod(c, family))
        told[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in told.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = {}
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if told[c] == p)
        out[min(m), len(p)] = (
            min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in under),
            sum((len(members[q]) - 1) * (words(q[-1][1]) if q else 0) for q in under), hashlib.sha256(ends.encode()).hexdigest(), len(under),
        )
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", 3, 4, 5) for r in rows], TURNS)


@pytest.mark.parametrize("span", [2, 64])
def test_trie_matches_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(conversation_trie, "SPAN", span)
    monkeypatch.setattr(running, "PIECE_ROWS", 13)
    monkeypatch.setattr(running, "HOT", 4)
    rng = random.Random(span)
    rows = [(None, 0, "a", "lost"), (7, None, None, None), (7, None, "user", ""), (7, 3, "user", " two  words\n"), (7, 3, "user", " two  words\n")]
    for c in [*range(-25, 65), 2**40, 2**40 + 3]:
        for t in range(rng.choice([0, 1, 2, 3, 6])):
            rows.append((c, t, rng.choice(["user", "bot"]) if t else "user", rng.choice(["hi", "how are you", "", "é x y", "hi\tthere"]) if t else "hello"))
    rows += [(61, t, "user", rng.choice(["a", "b b"])) for t in range(10, 33)]  # far deeper than the others
    rng.shuffle(rows)
    got = conversation_trie.prefix_trie(conversations(spark, rows)).collect()
    want = trie_brute(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[2:8]) + (r.end - r["rank"] + 1,) == want[r.conv_id, r.depth], (r, want[r.conv_id, r.depth])
    assert sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))
    by_rank = {r["rank"]: r for r in got}
    for r in got:  # a node's descendants are the next ones, and they are deeper
        assert all(by_rank[i].depth > r.depth for i in range(r["rank"] + 1, r.end + 1))


def test_trie_of_one_conversation_with_all_rows_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(running, "PIECE_ROWS", 100)
    rows = [(3, t, "u", "same") for t in range(700)] + [(4, 0, None, None)]
    got = {(r.conv_id, r.depth): r for r in conversation_trie.prefix_trie(conversations(spark, rows)).collect()}
    want = trie_brute(rows)
    assert {k: tuple(r[2:8]) for k, r in got.items()} == {k: v[:6] for k, v in want.items()}
    assert conversation_trie.prefix_trie(conversations(spark, [])).count() == 0
    long = "word " * 200_000
    assert conversations(spark, [(1, 1, "u", long), (1, 2, "u", "  "), (1, 3, "u", None)]).select(conversation_trie.n_words(F.coalesce("text", F.lit("")))).collect()[0][0] == 200_000


def test_common_ends_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(running, "PIECE_ROWS", 50)
    rows = [(c, 0, "u", "hello") for c in range(0, 2000)]
    got = {(r.conv_id, r.depth): r.ends_sha256 for r in conversation_trie.prefix_trie(conversations(spark, rows)).collect()}
    assert got == {k: v[5] for k, v in trie_brute(rows).items()}


def test_running_sums_in_groups_and_over_all(spark, monkeypatch):
    monkeypatch.setattr(running, "PIECE_ROWS", 7)
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 5]), i, rng.randrange(-9, 9), rng.getrandbits(62) - 2**61) for i in range(120)]
    df = U.stored(spark.createDataFrame(rows, "g long, o long, a long, x long").repartition(5), "running-test")
    for group in (None, "g"):
        got = {r.o: (r.run_a, r.run_x) for r in running.running(df, ["o"], group, adds=["a"], xors=["x"]).collect()}
        for g, o, _, _ in rows:
            seen = [r for r in rows if r[1] <= o and (group is None or r[0] == g)]
            x = 0
            for r in seen:
                x ^= r[3]
            assert got[o] == (sum(r[2] for r in seen), x)


def trust_brute(pages, rules, share=0.5, rounds=20):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    hosts, paths, hits, links = [], [], [], set()
    for _, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = lower(m[1]), m[2]
        fit = [(len(r), r, a) for a, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        hosts.append(host), paths.append(path), hits.append(max(fit)[1:] if fit else (None, None))
        for h in re.findall(url_trust._LINK, html or ""):
            if host and lower(h) != host:
                links.add((host, lower(h)))
    score = {}
    for way, action, edges in (("trust", "allow", links), ("distrust", "block", {(b, a) for a, b in links})):
        seed = defaultdict(int)
        for h, (_, a) in zip(hosts, hits):
            if a == action and h:
                seed[h] += url_trust.UNIT
        out = defaultdict(list)
        for a, b in edges:
            out[a].append(b)
        now = dict(seed)
        for _ in range(rounds):
            new = defaultdict(int)
            for h, s in seed.items():
                new[h] += s * 15 // 100
            for h, s in now.items():
                for to in out[h]:
                    new[to] += s * 85 // (100 * len(out[h]))
                if not out[h]:
                    new[h] += s * 85 // 100
            now = new
        score[way] = now
    n = {h: hosts.count(h) for h in hosts}
    res = []
    for (i, _, _), h, p, (rule, action) in zip(pages, hosts, paths, hits):
        t, d = score["trust"].get(h, 0), score["distrust"].get(h, 0)
        res.append((i, h, p, rule, action or ("block" if d - t > n[h] * share * url_trust.UNIT else "allow"), t, d))
    return res


def pages_of(spark, pages):
    return spark.createDataFrame([(*p, "x", 1, "y") for p in pages], "page_id long, url string, html string, host string, n long, verdict string")


def test_url_trust_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_trust, "lookup", running.lookup)
    monkeypatch.setattr(running, "HOT", 3)  # the busiest hosts take the broadcast way
    rng = random.Random(8)
    hosts = [f"h{i}.example.{rng.choice(['net', 'com', 'org', 'com'])}" for i in range(14)]
    pages = [(0, None, None), (1, "no scheme", "<a href='http://h1.example.net/'>"), (2, "http://net", "x"), (3, "http://NET/a?x#y", ""), (4, "http://a.example.net/en/", ""), (5, "http://example.com/de", ""), (6, "://", None), (7, "http://xnet/", "")]
    for i in range(8, 90):
        h = rng.choice(hosts[:3] if i % 3 else hosts)
        links = "".join(f'<a HREF = "{rng.choice(["https:", "http:", ""])}//{rng.choice(hosts)}/p{i}">' for _ in range(rng.randrange(3)))
        pages.append((i, f"http://{h.upper() if i % 7 == 0 else h}/{rng.choice(['de', 'en', 'fr', ''])}/{i}?q=//x", links + "<a href=/local>"))
    pages += [pages[40], pages[40]]
    got = sorted(map(tuple, url_trust.judge(pages_of(spark, pages), registry.URL_RULES).collect()), key=str)
    want = sorted(trust_brute(pages, registry.URL_RULES), key=str)
    assert got == want
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}  # the links decide both ways


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    pages = [(i, f"http://bad.net/{i}", "") for i in range(20)] + [(30, "http://farm.com/1", '<a href="http://bad.net/">'), (31, "http://news.com/1", '<a href="http://good.org/">'), (32, "http://good.org/fr/1", '<a href="http://other.com/">'), (33, "http://other.com/", "")]
    got = {r.page_id: (r.verdict, r.trust > 0, r.distrust > 0) for r in url_trust.judge(pages_of(spark, pages), registry.URL_RULES).collect()}
    assert got[30] == ("block", False, True) and got[31] == ("allow", False, False) and got[33] == ("allow", True, False)
    assert url_trust.judge(pages_of(spark, []), registry.URL_RULES).count() == 0
    with pytest.raises(ValueError):
        url_trust.fitting_rule(F.lit("a"), F.lit("/"), [("allow", f"{i}/") for i in range(1001)])


def test_url_trust_runs_no_python(spark):
    plan = url_trust.host_links(pages_of(spark, [(1, "http://a/", "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


VECTORS = "vec_id long, embedding array<float>, cluster int, x string, distance long"


def means_brute(rows, k, rounds, dim, scale):
    rows = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(min(max(float(np.float32(c)) * scale, -(2**26)), 2**26))) for c in v] for _, v in rows], object).reshape(-1, dim)
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), tuple(x[r])) for r, (i, _) in enumerate(rows) if i is not None)[:k]
    cents = [list(v) for _, v in order]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for r in range(rounds + 1):
        who = [min((dist(v, c), j) for j, c in enumerate(cents)) for v in x]
        if r < rounds:
            for j in range(len(cents)):
                mine = [v for v, (_, w) in zip(x, who) if w == j]
                if mine:
                    cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    inertia = defaultdict(int)
    for d, j in who:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(rows, who)), key=str)


def test_sort_means_matches_full_scans(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=4).round(1) + 3 * (i % 5)]) for i in range(300)]
    rows += [rows[7], rows[7], (8, [1.0, 1.0, 1.0, 1.0]), (None, [0.0, 1.0, 2.0, 3.0]), (900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1.0] * 5), (906, [3e38, -3e38, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    for k, scale in ((16, 64.0), (7, 1.0)):
        got = sorted(map(tuple, sort_means.cluster(df, k, 3, 4, scale).collect()), key=str)
        assert got == means_brute(rows, k, 3, 4, scale)
    few = spark.createDataFrame([(*r, 1, "x", 2) for r in rows[:3]], VECTORS)
    assert sorted(map(tuple, sort_means.cluster(few, 16, 3, 4).collect()), key=str) == means_brute(rows[:3], 16, 3, 4, 64.0)
    assert sort_means.cluster(df.where("vec_id = -1"), 16, 3, 4).count() == 0


def test_sort_means_takes_few_distances():
    rng = np.random.default_rng(1)
    cents = rng.integers(-999, 999, (40, 6))
    x = cents[rng.integers(0, 40, 5000)] + rng.integers(-20, 20, (5000, 6))
    near = ((x[:, None] - cents[None]) ** 2).sum(2)
    before = near.argmin(1)
    before[::50] = 3  # some stand far from where they were
    cluster, best, taken = sort_means.nearest(x, before, cents, *sort_means.neighbours(cents))
    assert (cluster == near.argmin(1)).all() and (best == near.min(1)).all()
    assert taken < 5000 * 40 / 8
