"""Secret scans: base patterns, and automata inferred from labelled credentials for all other candidates."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.automata import Automaton, infer, symbols
from tessera.llm.portions import slices

# The base patterns, the group whose length counts, and the least length.
BASE = (
    (
        "assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2,
        12
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_.=-]*[A-Za-z0-9+/_=-])?")
INFERRED = "grammar"
#: The least length of a candidate, and the marks in it that may join two strings.
LEAST, MARKS = 16, "+/_.=-"
#: Strings per format in the labelled set; what the automata hold is bounded by it.
LABELLED = 120

LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Public formats as literal text and (alphabet, length) parts.
CREDENTIALS = (
    (("ghp_",), (UPPER + LOWER + DIGIT, 36)),
    (("github_pat_",), (UPPER + LOWER + DIGIT, 22), ("_",), (UPPER + LOWER + DIGIT, 59)),
    (("glpat-",), (UPPER + LOWER + DIGIT + "_-", 20)),
    (("xoxb-",), (DIGIT, 12), ("-",), (DIGIT, 12), ("-",), (UPPER + LOWER + DIGIT, 24)),
    (("sk_live_",), (UPPER + LOWER + DIGIT, 24)),
    (("AIza",), (UPPER + LOWER + DIGIT + "_-", 35)),
    (("sk-",), (UPPER + LOWER + DIGIT, 48)),
    ((UPPER + LOWER + DIGIT + "+/", 40),),
    ((UPPER + LOWER + DIGIT, 32),),
    ((UPPER + LOWER + DIGIT + "+/", 43), ("=",)),
    ((UPPER + DIGIT, 40),),
    ((UPPER + LOWER + DIGIT, 20),),
    ((UPPER + LOWER + DIGIT, 16),),
    ((UPPER + LOWER, 24),),
    (("eyJ",), (UPPER + LOWER + DIGIT, 33), (".eyJ",), (UPPER + LOWER + DIGIT, 60), (".",), (UPPER + LOWER + DIGIT + "_-", 43)),
    (("SG.",), (UPPER + LOWER + DIGIT + "_-", 22), (".",), (UPPER + LOWER + DIGIT + "_-", 43)),
    (("npm_",), (UPPER + LOWER + DIGIT, 36)),
    (("hf_",), (UPPER + LOWER, 34)),
    (("ya29.",), (UPPER + LOWER + DIGIT + "_-", 60)),
)


def _stream(seed: str) -> Iterator[int]:
    n = 0
    while True:
        yield from hashlib.sha256(f"{seed}:{n}".encode()).digest()
        n += 1


def _pick(source: Iterator[int], n: int) -> int:
    return ((next(source) << 16) + (next(source) << 8) + next(source)) % n


def labelled() -> tuple[list[str], list[list[str]]]:
    """Credentials by the formats above, and strings of the same lengths that are none: words and numbers run together
    or joined by marks, in lower, upper and camel case, a list for each; addresses, files and versions; dates, numbers
    and rules of one sign; hex ids in groups."""
    good, plain, names, numbers, ids = [], ([], [], []), [], [], []
    for k, parts in enumerate(CREDENTIALS):
        source = _stream(f"credential {k}")
        good += ["".join(p[0] if len(p) == 1 else "".join(p[0][_pick(source, len(p[0]))] for _ in range(p[1])) for p in parts) for _ in range(LABELLED)]
    source = _stream("plain")
    vowels, rest = "aeiou", "bcdfghjklmnpqrstvwxyz"

    def some(letters: str, least: int, most: int) -> str:
        return "".join(letters[_pick(source, len(letters))] for _ in range(least + _pick(source, most - least + 1)))

    def word() -> str:
        return "".join(some(rest, 0, 2) + some(vowels, 1, 2) + some(rest, 0, 2) for _ in range(1 + _pick(source, 4)))

    marks = ("", "_", "-", "/", "-", "_", ".", ".")
    for n in range(LABELLED * 40):
        words = [word() for _ in range(12)]
        words = [w.upper() if n % 5 == 1 else w.capitalize() if n % 5 == 2 or (n % 5 == 3 and i) else w for i, w in enumerate(words)]
        if n % 3 == 0:
            words.insert(_pick(source, 4), str(_pick(source, 10 ** (1 + _pick(source, 6)))))
        text = marks[_pick(source, len(marks))].join(words)
        plain[(0, 1, 2, 2, 0)[n % 5]].append(text[: LEAST + _pick(source, 44)].rstrip("/_-."))
    for _ in range(LABELLED):
        # addresses, files, versions, dates, numbers, rules of one sign, ids in groups
        year, rest_of = 1990 + _pick(source, 60), [f"{_pick(source, 60):02d}" for _ in range(6)]
        numbers.append(f"{year}-" + "-".join(rest_of) + f"/{_pick(source, 10**6)}")
        names.append(f"www.{word()}{word()}.{word()[:3]}/{word()}/{word()}{_pick(source, 1000)}/{word()}-{word()}.html")
        names.append(f"{word()}-{word()}-{_pick(source, 30)}.{_pick(source, 30)}.{_pick(source, 300)}.tar.gz")
        names.append("-".join((f"{word()[:1 + _pick(source, 4)]}{_pick(source, 100)}_{_pick(source, 100)}", *(word()[: 2 + _pick(source, 4)] for _ in range(3)), str(_pick(source, 30)))))
        names.append(f"/{word()}/{word()}/{word()}{_pick(source, 10)}.{_pick(source, 10)}/{word()}-{word()}/{word()}_{word()}.py")
        numbers.append("".join(DIGIT[_pick(source, 10)] for _ in range(LEAST + _pick(source, 24))))
        numbers.append("-".join("".join(DIGIT[_pick(source, 10)] for _ in range(4)) for _ in range(4 + _pick(source, 3))))
        ids.append("-".join("".join("0123456789abcdef"[_pick(source, 16)] for _ in range(k)) for k in (8, 4, 4, 4, 12)))
        numbers.append(".".join(str(_pick(source, 256)) for _ in range(4 + _pick(source, 3))) + f"/{_pick(source, 33)}-{rest_of[0]}")
        numbers.append("=-_/+."[_pick(source, 6)] * (LEAST + _pick(source, 64)))
    return good, [*plain, names, numbers, ids]


Models = tuple[Automaton, ...]


def likelihood(text: str, models: Models) -> float:
    """How much likelier, in nats per character, the first automaton, of credentials, makes a string than the likeliest
    of the others."""
    s = symbols(text)
    return (models[0].score(s) - max(m.score(s) for m in models[1:])) / max(1, len(s))


@functools.lru_cache(1)
def fitted() -> tuple[Models, float]:
    """Automata of the credentials and of each list of plain strings, and the limit: learnt from two thirds of the
    labelled strings, the limit set on the rest so that all plain ones stay below it."""
    good, plain = labelled()
    models = tuple(infer(x for i, x in enumerate(xs) if i % 3) for xs in (good, *plain))
    return models, max(0.05, 1.1 * max(likelihood(x, models) for xs in plain for i, x in enumerate(xs) if not i % 3))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [
        (m.start(), i, m.end(), kind) for i,
        (kind, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text) if len(m.group(group)) >= least
    ]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def left_over(start: int, end: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a run that no base span covers; base spans by start."""
    parts, at = [], start
    for a, b, _ in base:
        if a < end and b > at:
            if a > at:
                parts.append((at, a))
            at = b
    return [*parts, (at, end)] if at < end else parts


def spans(text: str | None, models: Models, limit: float) -> list[tuple[int, int, str]]:
    """All spans of a text, by start, then kind in the order of BASE.

    Every candidate is scored. Of one that base spans cover in part the parts left are scored, with and without the
    mark that joins them to the base span, and if none is a credential the whole; one they cover adds nothing.
    """
    text = text or ""
    base = base_spans(text)
    more = []
    score = lambda span: likelihood(text[span[0] : span[1]], models)
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if end - start < LEAST:
            continue
        found = []
        parts = left_over(start, end, base)
        for a, b in parts:
            firsts = (a, a + 1) if a > start and text[a] in MARKS else (a,)
            lasts = (b, b - 1) if b < end and text[b - 1] in MARKS else (b,)
            best = max(((x, y) for x in firsts for y in lasts if y - x >= LEAST), key=score, default=None)
            if best and score(best) > limit:
                found.append((*best, INFERRED))
        if parts and not found and parts != [(start, end)] and score((start, end)) > limit:
            found = [(start, end, INFERRED)]
        more += found
    order = {kind: i for i, (kind, *_) in enumerate(BASE)}
    return sorted(base + more, key=lambda s: (s[0], order.get(s[2], len(order)), s[1]))


def redacted(text: str, found: list[tuple[int, int, str]], mask: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for a, b, _ in sorted(found):
        if b > at:
            if a >= at:
                out += [text[at:a], mask]
            at = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` per document, spans an array of ``(kind, start, end)`` in code points, end exclusive.

    A null text counts as empty and has no spans; texts of any length are searched whole; spans that start together
    come in the order of the kinds, those found by the automata last; repeated rows stay; an empty table gives no rows;
    other columns are not read.
    """
    models, limit = fitted()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(t, models, limit)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("doc_id", id_col)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with all spans masked and the count of characters set anew where there is such a column; null
    texts and all other columns stay as they are."""
    models, limit = fitted()
    names = docs.columns
    at, count = names.index(text_col), names.index(chars_col) if chars_col in names else -1
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            columns = list(b.columns)
            texts = [t if t is None else redacted(t, spans(t, models, limit)) for t in b.column(at).to_pylist()]
            columns[at] = pa.array(texts, b.schema.types[at])
            if count >= 0:
                was = b.column(count).to_pylist()
                columns[count] = pa.array([n if t is None else len(t) for t, n in zip(texts, was, strict=True)], b.schema.types[count])
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return numbered.mapInArrow(run, numbered.schema).toDF(*names)


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans' list, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != INFERRED)
    return scanned.select(
        id_col, *(count(kind).alias(f"n_{kind}") for kind, *_ in BASE), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans")
    )
