"""Column expressions on texts: scrubbed errors, token shapes, call sites, entropy, red flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import once

# Volatile parts of an error text and what stands for them, in the order they apply.
ERROR_PARTS = (
    (r"\r\n", "\n"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<ts>"),
    (r"\b\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\b", "<ts>"),
    (r"\b0x[0-9a-fA-F]+\b", "<addr>"),
    (r"(?:/[\w.~-]+)+/([\w.-]+)", "$1"),
    (r"\b[A-Za-z]:\\(?:[\w.~ -]+\\)*([\w.-]+)", "$1"),
    (r":\d+(?::\d+)?\b", ":<n>"),
    (r"(?i)\bline \d+", "line <n>"),
    (r"\b\d+(?:\.\d+)?\s*m?s\b", "<dur>"),
)
# The same for the output of a failed run, on lower-cased text.
OUTPUT_PARTS = (
    (r"0x[0-9a-f]+", "0xADDR"),
    (r"\b\d+(\.\d+)?(ms|s)\b", "T"),
    (r":\d+:\d+", ":L:C"),
    (r"\b\d+\b", "N"),
    (r"/tmp/\S+", "/tmp/X"),
    (r"\s+", " "),
)
# Token classes of a task text, first match wins.
TOKEN_SHAPES = (
    ("⟨str⟩", r"""^["'`].*["'`]$"""),
    ("⟨num⟩", r"^-?\d[\d.,_]*$"),
    ("⟨path⟩", r"(?i)[\\/]|\.(?:m?[jt]sx?|py|go|rs|java|rb|json|ya?ml|toml|md|css|html)$"),
    ("⟨ident⟩", r"^(?:[a-z][a-z0-9]*[A-Z]|[A-Z][a-z0-9]+[A-Z]|\w+_\w+|\w+\.\w+)\w*$"),
)
TOKEN_EDGE = r"""^[^\w"'`./\\-]+|[^\w"'`./\\-]+$"""
CALL = r"(?:^|[^.\w$])([A-Za-z_$][\w$]*)\s*\("
# Instruction texts that ask for harm.
RED_FLAGS = {
    "curl_to_shell": r"(?i)\bcurl\b[^\n|]*\|\s*(sh|bash|zsh)\b",
    "wget_to_shell": r"(?i)\bwget\b[^\n|]*\|\s*(sh|bash|zsh)\b",
    "decoded_to_shell": r"(?i)base64\s+(--decode|-d|-D)\b[^\n]*\|\s*(sh|bash)",
    "injection": r"(?i)ignore\s+(all\s+)?(your\s+)?previous\s+instructions|disregard\s+(your|the|all)\s+(system|previous|prior)",
    "credential_read": r"(?i)(id_rsa|id_ed25519|\.aws/credentials|\.claude\.json|\.env)\b[^\n]{0,80}\b(curl|wget|nc|https?://|base64|>\s*/dev/tcp)",
    "recursive_delete": r"(?i)\brm\s+-rf\s+[~/]",
    "dynamic_code": r"(?i)\beval\s*\(\s*(await\s+)?fetch|child_process|\bexec(Sync)?\s*\(",
}


def scrubbed(text: Column, parts: Iterable[tuple[str, str]] = ERROR_PARTS) -> Column:
    for pattern, to in parts:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def failure_signature(text: Column, file: Column, symbol: Column) -> Column:
    """Digest of a scrubbed error and its place; equal problems in one place are equal."""
    return F.sha2(F.concat(scrubbed(text), F.lit("\0"), F.coalesce(file, F.lit("")), F.lit("\0"), F.coalesce(symbol, F.lit(""))), 256)


def output_signature(text: Column) -> Column:
    """Twelve hex digits for the first 800 characters of a scrubbed output; empty for no output."""
    norm = F.substring(scrubbed(F.lower(text), OUTPUT_PARTS), 1, 800)
    return F.when(norm == "", "").otherwise(F.substring(F.sha2(norm, 256), 1, 12))


def spec_shape(text: Column) -> Column:
    """A task text with its literals, paths and identifiers replaced by their classes."""

    def shape(t: Column) -> Column:
        out = F.lower(t)
        for name, pattern in reversed(TOKEN_SHAPES):
            out = F.when(t.rlike(pattern), name).otherwise(out)
        return out

    bare = F.filter(F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, TOKEN_EDGE, "")), lambda t: t != "")
    return F.array_join(F.transform(bare, shape), " ")


def called_symbols(text: Column, ignore: Iterable[str] = ()) -> Column:
    """Distinct called names, line by line, without member calls and those to ignore."""
    found = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.regexp_extract_all(line, F.lit(CALL), F.lit(1))))
    return F.array_except(found, F.array(*[F.lit(x) for x in ignore]).cast("array<string>"))


def concept_tokens(text: Column, stop: Iterable[str] = ()) -> Column:
    """Lower-cased parts of identifiers and paths, of three characters or more."""
    split = F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    stop = list(stop)
    return F.filter(split, lambda t: (F.length(t) >= 3) & (~t.isin(*stop) if stop else F.lit(True)))


def entropy(text: Column) -> Column:
    """Bits for each character of a text; 0 for an empty one."""

    def of(chars: Column) -> Column:
        # runs of equal characters in sorted order: their lengths are the counts
        n = F.size(chars)
        cuts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(chars, i) != F.get(chars, i - 1)))
        spans = F.zip_with(F.slice(cuts, 2, F.size(cuts)), cuts, lambda b, a: F.coalesce((b - a) / n, F.lit(0.0)))
        return F.when(n == 0, 0.0).otherwise(F.aggregate(spans, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0)))

    return once(F.sort_array(F.filter(F.split(text, ""), lambda c: c != "")), of)


# Rules that warn but do not block, and what an encoded payload looks like: length and bits for each character.
WARNINGS = ("recursive_delete", "dynamic_code")
BLOB, BLOB_BITS = r"[A-Za-z0-9+/=]{200,}", 4.5


def scanned(text: Column) -> Column:
    """``flags, blobs, critical, high, safe`` of an instruction text; safe is only the absence of a known shape.  Null is empty."""

    def found(t: Column) -> Column:
        blobs = F.size(F.filter(F.regexp_extract_all(t, F.lit(BLOB), F.lit(0)), lambda b: entropy(b) >= BLOB_BITS))
        return F.struct(red_flags(t).alias("flags"), blobs.alias("blobs"))

    def judged(s: Column) -> Column:
        warned = F.arrays_overlap(s["flags"], F.array(*map(F.lit, WARNINGS)))
        critical, high = F.size(F.array_except(s["flags"], F.array(*map(F.lit, WARNINGS)))) > 0, warned | (s["blobs"] > 0)
        return F.struct(s["flags"].alias("flags"), s["blobs"].alias("blobs"), critical.alias("critical"), high.alias("high"), (~critical & ~high).alias("safe"))

    return once(once(F.coalesce(text, F.lit("")), found), judged)


def red_flags(text: Column) -> Column:
    """Names of the rules that a text breaks."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in RED_FLAGS.items()]))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.6)
