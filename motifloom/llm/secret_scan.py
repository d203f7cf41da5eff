"""Secrets in texts: three base patterns and a battery of randomness tests.

Candidates of the battery are all maximal runs of ``MIN_RUN`` or more characters of base64 and its URL form.  From its
characters each gets an encoding (hexadecimal, base32, alphanumeric, base64), and under that encoding three tests of
uniform randomness: chi-squared of the symbol counts, the runs test about the median, and the serial correlation of
neighbours, combined by Fisher's rule.  A candidate that the battery rejects is no secret.  A run with marks, as a prefix
or groups make them, that is rejected whole gets a second reading: its longest part between marks if that is long enough,
as in ``kind_<token>``, else all its letters and digits without marks, as in a UUID.  The second reading's evidence is
halved, so that two readings count as one test; its span is the part, or the run.

For those that it does not reject, the p-value under the hypothesis "ordinary text" is the bound 1 / LR of Wald, LR
being the likelihood ratio of uniform symbols against the character frequencies of the whole corpus (case folded), so
longer candidates have more power.  Benjamini-Hochberg over all candidates of the corpus, within strata of length,
then holds the share of false discoveries below ``fdr``.  The p-values are rounded up to ``GRID`` steps per factor of
e, so that their counts form a table of bounded size; rounding up can only lose power.

Null texts count as empty; empty texts have no spans.  Repeated rows are scanned alike and each is returned, and they
count as often as they occur in the corpus statistics.  Offsets are code points, ends are exclusive.  Of base patterns
that overlap each keeps its span; spans of one start stand in the order of their kinds.  An empty table gives no rows.
A very long text is scanned whole, in time that grows with its length and with a few dozen bytes of memory a character.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.shared import checkpoint

KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 16
STRATA = (24, 32, 48)  # lengths at which a new stratum begins
GRID, DEEPEST = 20, 300  # steps of ln p, largest -ln p
CHUNK = 1 << 20  # characters of candidates tested at a time

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")

_code = np.arange(129)
_is = {name: np.isin(_code, [*map(ord, chars)]) for name, chars in {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "digit": "0123456789", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "mark": "+/-_"}.items()}
_run = _is["digit"] | _is["lower"] | _is["upper"] | _is["mark"]


def _places(alphabet: str, more: str = "") -> np.ndarray:
    """Index of each character in an alphabet; ``more`` names the same symbols once again from its last ones."""
    out = np.zeros(129, np.int64)
    for i, c in enumerate(alphabet):
        out[ord(c)] = i
    for i, c in enumerate(more):
        out[ord(c)] = len(alphabet) - len(more) + i
    return out


_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: For each encoding: its size and the indices of its symbols.
ENCODINGS = [
    (16, np.maximum(_places(_DIGIT + "abcdef"), _places(_DIGIT + "ABCDEF"))),
    (32, _places(_UPPER + "234567")),
    (36, np.maximum(_places(_DIGIT + _LOWER), _places(_DIGIT + _UPPER))),
    (62, _places(_UPPER + _LOWER + _DIGIT)),
    (64, _places(_UPPER + _LOWER + _DIGIT + "+/", "-_")),
]
#: Case-folded class of each character for the comparison with text: letters 0 to 25, digits 26 to 35, others -1.
FOLDED = np.full(129, -1)
FOLDED[97:123] = FOLDED[65:91] = np.arange(26)
FOLDED[48:58] = np.arange(26, 36)


def _tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal distribution."""
    return np.maximum([0.5 * math.erfc(x / math.sqrt(2)) for x in z], 1e-300)


def runs_of(codes: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``least`` or more characters that are in ``table``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], table[codes], [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def battery(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For runs of character codes: the encoding's index (-1: only digits or marks) and the battery's p-value."""
    ends, found, at = np.cumsum([len(t) for t in tokens]), [], 0
    while at < len(tokens):  # so many at a time that the arrays stay small
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        found.append(_battery(tokens[at:stop]))
        at = stop
    return np.concatenate([e for e, _ in found]), np.concatenate([p for _, p in found])


def _battery(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in tokens])
    flat, first = np.concatenate(tokens), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(tokens)), sizes)
    every = lambda name: np.logical_and.reduceat(_is[name][flat], first)
    some = lambda name: np.logical_or.reduceat(_is[name][flat], first)
    letters = some("lower") | some("upper")
    encoding = np.select([~letters, every("hex") | every("HEX"), every("base32"), some("mark"), ~some("lower") | ~some("upper")], [-1, 0, 1, 4, 2], 3)
    size = np.array([k for k, _ in ENCODINGS])[encoding].astype(float)
    place = np.choose(encoding[owner] % 5, [p[flat] for _, p in ENCODINGS])
    n = sizes.astype(float)
    _, cell, count = np.unique(owner * 64 + place, return_index=True, return_counts=True)
    squares = np.bincount(owner[cell], count.astype(float) ** 2, len(tokens))
    chi = size / n * squares - n
    p_chi = _tail((chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n))
    inner = np.ones(len(flat), bool)
    inner[first] = False
    pair = np.flatnonzero(inner)
    half = place >= (size / 2)[owner]
    changes = np.bincount(owner[pair], half[pair] != half[pair - 1], len(tokens))
    p_runs = np.minimum(1, 2 * _tail(np.abs(changes - (n - 1) / 2) / np.sqrt((n - 1) / 4)))
    u = place - (size[owner] - 1) / 2
    serial = np.bincount(owner[pair], u[pair] * u[pair - 1], len(tokens)) / ((size**2 - 1) / 12) / np.sqrt(n - 1)
    p_serial = np.minimum(1, 2 * _tail(np.abs(serial)))
    s = -(np.log(p_chi) + np.log(p_runs) + np.log(p_serial))
    return encoding, np.exp(-s) * (1 + s + s * s / 2)


def uniform_folded(k: int) -> np.ndarray:
    """Probability of each case-folded class under uniform symbols of an encoding; both cases count for one letter."""
    if k == 16:
        return np.r_[np.full(6, 1 / 16), np.full(20, 1e-9), np.full(10, 1 / 16)]
    if k == 32:
        return np.r_[np.full(26, 1 / 32), np.full(2, 1e-9), np.full(6, 1 / 32), np.full(2, 1e-9)]
    if k == 36:
        return np.full(36, 1 / 36)
    return np.r_[np.full(26, 2 / k), np.full(10, 1 / k)]


def second_reading(token: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """(start, end, codes) of another reading of a run with marks, if one is long enough."""
    marks = _is["mark"][token]
    if not marks.any():
        return None
    start, end = runs_of(token, _run & ~_is["mark"], MIN_RUN)
    if len(start):
        i = int(np.argmax(end - start))
        return int(start[i]), int(end[i]), token[start[i] : end[i]]
    rest = token[~marks]
    return (0, len(token), rest) if len(rest) >= MIN_RUN else None


def base_spans(text: str, codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(s, 2, e) for s, e in zip(*(x.tolist() for x in runs_of(codes, _is["hex"], 24)))]
    return sorted(found)


def touched(start: np.ndarray, end: np.ndarray, base: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of the spans overlap one of the base spans, which come in order: of those that begin before a span's end
    the furthest end lies behind its start."""
    if not base:
        return np.zeros(len(start), bool)
    furthest = np.maximum.accumulate([b for _, _, b in base])
    before = np.searchsorted([a for a, _, _ in base], end, "left")
    return (before > 0) & (furthest[np.maximum(before, 1) - 1] > start)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, *, fdr: float = 0.01, alpha: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` and ``n_random`` of every row.

    ``alpha``: the battery rejects below it.  A random span that touches a base span is not added."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    candidate = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("size", pa.int16()), ("token", pa.string()), ("ways", pa.int8())])

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seen = np.zeros(129, np.int64)
                spans, random = [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for text in texts:
                    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)
                    seen += np.bincount(codes, minlength=129)
                    base = base_spans(text, codes)
                    spans.append(base)
                    own = []
                    start, end = runs_of(codes, _run, MIN_RUN)
                    if len(start):
                        encoding, p = battery([codes[s:e] for s, e in zip(start, end)])
                        free = np.flatnonzero((encoding >= 0) & ~touched(start, end, base)).tolist()
                        again = {i: x for i in free if p[i] < alpha and (x := second_reading(codes[start[i] : end[i]]))}
                        other = dict(zip(again, zip(*(x.tolist() for x in battery([x[2] for x in again.values()]))))) if again else {}
                        for i in free:
                            s, e, size, token, ways = int(start[i]), int(end[i]), ENCODINGS[encoding[i]][0] if p[i] >= alpha else 0, text[start[i] : end[i]], 1
                            c, q = other.get(i, (-1, 0.0))
                            if c >= 0 and q >= alpha:
                                a, b, rest = again[i]
                                s, e, size, token, ways = s + a, s + b, ENCODINGS[c][0], rest.astype("<u4").tobytes().decode("utf-32-le"), 2
                            own.append({"start": s, "end": e, "size": size, "token": token, "ways": ways})
                    random.append(own)
                n = [[sum(k == j for _, k, _ in x) for x in spans] for j in range(3)]
                rows = pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array([joined(x) for x in spans]), pa.array(random, pa.list_(candidate)), pa.nulls(len(texts), pa.list_(pa.int64()))],
                    names=names,
                )
                yield rows
                counts = np.bincount(FOLDED[FOLDED >= 0], seen[FOLDED >= 0], 36).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(rows.schema)[:-1]), pa.array([counts.tolist()], pa.list_(pa.int64()))], names=names)

    names = [id_col, "n_assign", "n_access", "n_hex", "base", "candidates", "chars"]
    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base string, candidates array<struct<start:int,end:int,size:smallint,token:string,ways:tinyint>>, chars array<long>"
    read = docs.select(id_col, text_col).mapInArrow(first_pass, schema)
    read = checkpoint(read)
    # 36 sums: the corpus frequencies of letters and digits, smoothed by one
    sums = read.where("chars is not null").agg(*(F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(36))).first()
    text = np.array([(x or 0) + 1.0 for x in sums])
    gain = {k: np.log(uniform_folded(k) / (text / text.sum())) for k, _ in ENCODINGS}

    def depth(size: int, token: str, ways: int) -> int:
        """Floor of -ln p in steps of the grid, p times the number of readings; 0 for what the battery rejects."""
        if not size:
            return 0
        folded = FOLDED[np.frombuffer(token.encode(), np.uint8)]
        return int(GRID * min(DEEPEST, max(0.0, gain[size][folded[folded >= 0]].sum() - math.log(ways))))

    def stratum(n: int) -> int:
        return sum(n >= x for x in STRATA)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(STRATA) + 1, GRID * DEEPEST + 1), np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                for c in own:
                    total[stratum(len(c["token"])), depth(c["size"], c["token"], c["ways"])] += 1
        s, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d), pa.array(total[s, d])], names=["s", "d", "n"])

    held = read.where("chars is null")
    counts = held.where("size(candidates) > 0").select("candidates").mapInArrow(tally, "s long, d long, n long").groupBy("s", "d").agg(F.sum("n").alias("n"))
    least = step_up(counts.collect(), fdr)  # at most (len(STRATA) + 1) * (GRID * DEEPEST + 1) rows, whatever the corpus

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans, found = batch.column(4).to_pylist(), [], []
            for b, own in zip(base, batch.column(5).to_pylist()):
                more = [(c["start"], 3, c["end"]) for c in own if depth(c["size"], c["token"], c["ways"]) >= least[stratum(len(c["token"]))]]
                all_ = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in b.split(",") if x)] + more
                spans.append(joined(sorted(all_)))
                found.append(len(more))
            sha = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(found, pa.int64())], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return held.select(*names[:-1]).mapInArrow(second_pass, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def step_up(counts: list, fdr: float) -> list[float]:
    """For each stratum of length the least depth of -ln p that Benjamini-Hochberg accepts (infinite: none)."""
    out = []
    for s in range(len(STRATA) + 1):
        own = sorted(((r["d"], r["n"]) for r in counts if r["s"] == s), reverse=True)
        total, so_far, least = sum(n for _, n in own), 0, math.inf
        for d, n in own:
            so_far += n
            if d > 0 and math.exp(-d / GRID) * total <= fdr * so_far:
                least = d
        out.append(least)
    return out
