"""Personal data in whole texts: fixed patterns, and spans that a tagger adds (operator 13).

Base spans follow four patterns (mail address, network address, card, telephone) with their checks. The tagger (see
``tagger``) learns from labelled spans: windows around base spans of the corpus, as they are and in disguises (a bracketed
at sign, other separators, digits close by, no plus sign), and windows without any. It reads every text in overlapping windows of
``WINDOW`` characters. Each window is decoded for itself; the windows of a text are then reconciled as a whole: pieces
that touch a window's edge join their continuation in the next one, and the heaviest set of spans that don't overlap is
chosen. A chosen span is added if its marginals reach ``SURE``, nothing of it lies in a base span, no letter or digit
adjoins it, and it passes its kind's check with the disguise taken off.

Every added span holds a digit, an at sign or a bracketed "at" by that check, so windows without such a character can hold none, and are not
decoded. The rest of a text costs the patterns' scan only.

Defined results: a null text is an empty one and has no spans; null ids and repeated rows are returned as they come; no rows
give an empty result; without base spans anywhere there is nothing to learn and nothing is added. A text of any length is one row in one
task, its windows go through the tagger ``BATCH`` at a time. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .tagger import Tagger, classes

KINDS = ("email", "ip", "card", "phone")
#: Labelled windows of each kind, and windows without spans, that the tagger learns from at most: the bound of its sample.
MAX_LABELLED, MAX_CLEAN = 300, 900
WINDOW, STRIDE = 96, 48
BATCH = 512
STEPS, STEP_ROWS = 200, 64
SURE = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[\[({<] ?at ?[\])}>]", re.IGNORECASE)
_NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _card(found: str) -> bool:
    digits = _NO_DIGIT.sub("", found)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone(found: str) -> bool:
    return 9 <= len(_NO_DIGIT.sub("", found)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, at sign and domain, from at sign to at sign: as the pattern's leftmost matches, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    # dotted runs are taken whole: one of fewer than four parts holds no match, and so each digit is looked at once
    out += [(m.start(), 1, m.end()) for m in _DOTTED.finditer(text) if m[0].count(".") == 3 and all(map(_byte, m[0].split(".")))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _card(m[0])]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if _phone(m[0])]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
_BANNED = [(a, 2 + 2 * k) for k in range(len(KINDS)) for a in range(TAGS) if a not in (1 + 2 * k, 2 + 2 * k)]


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for a, k, b in spans:
        if not out[max(a, 0) : b].any():
            out[max(a, 0) : b] = 2 + 2 * k
            if a >= 0:
                out[a] = 1 + 2 * k
    return out


def _undisguised(kind: int, found: str) -> bool:
    """Whether a span that the tagger found passes its kind's check."""
    if kind == 0:
        plain = re.sub(r"\s*(?:[\[({<] ?(?:at|@) ?[\])}>]|@)\s*", "@", found, flags=re.IGNORECASE)
        plain = re.sub(r"\s*[\[({<] ?(?:dot|\.) ?[\])}>]\s*", ".", plain, flags=re.IGNORECASE)
        return [(0, len(plain))] == list(_emails(plain))
    if kind == 1:
        parts = re.split(r"\s*(?:[\[({] ?(?:\.|dot) ?[\])}]|\.)\s*", found, flags=re.IGNORECASE)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ ./_-]{0,2}[0-9])+", found)) and _card(found)
    return bool(re.fullmatch(r"[+(]{0,2}[0-9][ ()./0-9-]+[0-9]", found)) and _phone(found) and bool(re.match(r"\+|00|\(|[0-9]{1,3}[ (]", found))


def _disguised(r: np.random.Generator, kind: int, found: str) -> str:
    """A span as people write it to be read by people only, or in another house style."""
    pick = lambda *a: a[int(r.integers(len(a)))]
    if kind == 0:
        found = found.replace("@", pick(" (at) ", "(at)", "[at]", " [at] ", " @ ", "{at}"))
        return found.replace(".", pick(".", ".", "[dot]", " (dot) "))
    if kind == 1:
        return found.replace(".", pick("[.]", "(.)", " . ", "[dot]"))
    digits = _NO_DIGIT.sub("", found)
    if kind == 2:
        return pick(" ", "-", ".", " - ", "/").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    bare = found.lstrip("+")
    return pick(bare, "00" + bare, "00 " + bare, "(+" + bare[:1] + ")" + bare[1:], "+" + pick(".", "/", " / ").join((digits[:3], digits[3:6], digits[6:])))


def sample_windows(text: str) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """(kind, window, spans in it) around every base span, and with kind -1 every window without one that holds a mark, or the text's first."""
    spans = base_spans(text)
    for a, k, b in spans:
        start = max(0, a - WINDOW)
        part = text[start : b + WINDOW]
        yield k, part, [(x - start, y, z - start) for x, y, z in spans if x >= start and z <= start + len(part)]
    if not spans:
        first = True
        for start in marked_windows(text):
            yield -1, text[start : start + WINDOW], []
            first = False
        if first and text:
            yield -1, text[:WINDOW], []


def marked_windows(text: str) -> list[int]:
    """Starts of the windows that hold a mark, ascending; the windows of a text lie ``STRIDE`` apart, and each but the last is full."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    out = set()
    for m in _MARK.finditer(text):
        for at in {m.start(), m.end() - 1}:
            w = at // STRIDE
            out.update(min(x, last) for x in (w - 1, w) if x >= 0)
    return [STRIDE * w for w in sorted(out)]


def batches_of(rows: list[tuple[int, str, list]], seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training batches, by turns from every kind; half of the labelled spans in disguise."""
    r = np.random.default_rng(seed)
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    kinds = sorted(by)
    for _ in range(STEPS):
        ids, tags = np.zeros((STEP_ROWS, WINDOW), np.int64), np.zeros((STEP_ROWS, WINDOW), np.int64)
        for n in range(STEP_ROWS):
            own = by[kinds[n % len(kinds)] if n % 3 or -1 not in by else -1]
            kind, part, spans = own[int(r.integers(len(own)))]
            if kind >= 0:
                part, spans = _changed(r, part, spans)
                a = spans[int(r.integers(len(spans)))][0]
                start = max(0, a - int(r.integers(0, WINDOW - 8)))
            else:
                start = 0
            window = part[start : start + WINDOW]
            ids[n, : len(window)] = classes(window)
            tags[n, : len(window)] = tags_of(len(window), [(x - start, k, z - start) for x, k, z in spans if z > start and x < start + WINDOW])
        yield ids, tags


def _changed(r: np.random.Generator, part: str, spans: list) -> tuple[str, list]:
    """A labelled window with some spans in disguise and some digits put beside spans."""
    text, out, at = "", [], 0
    for a, k, b in spans:
        if a < at:
            continue
        text += part[at:a]
        found, change = part[a:b], r.random()
        if change < 0.45:
            found = _disguised(r, k, found)
        elif change < 0.6 and k:
            text += f"{int(r.integers(1, 9999))} "
        out.append((len(text), k, len(text) + len(found)))
        text += found
        if 0.6 <= change < 0.75:
            text += f" {int(r.integers(1, 9999))}"
        at = b
    return text + part[at:], out


def learn(docs: DataFrame) -> bytes | None:
    """A packed tagger from a bounded sample of windows: of each kind the ``MAX_LABELLED`` (without spans: ``MAX_CLEAN``) different windows of
    smallest hash over all texts. The sample is learnt in one task; None without labelled windows. docs: text."""
    most = {-1: MAX_CLEAN, **dict.fromkeys(range(len(KINDS)), MAX_LABELLED)}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {k: [] for k in most}  # the smallest hashes so far, negated
        held: dict[int, dict] = {k: {} for k in most}
        for batch in batches:
            for text in batch.column(0):
                for kind, part, spans in sample_windows(text.as_py() or ""):
                    key = -int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")
                    heap, own = heaps[kind], held[kind]
                    if key in own or len(heap) >= most[kind] and key <= heap[0]:
                        continue
                    own[key] = (part, [x for s in spans for x in s])
                    if len(heap) < most[kind]:
                        heapq.heappush(heap, key)
                    else:
                        own.pop(heapq.heappushpop(heap, key))
        rows = [(k, -key, *value) for k, own in held.items() for key, value in own.items()]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["kind", "hash", "part", "spans"])

    found = stored(docs.mapInArrow(tidy(gather), "kind long, hash long, part string, spans array<long>"), "windows")
    sample = reduce(DataFrame.union, [found.filter(F.col("kind") == k).dropDuplicates(["hash"]).orderBy("hash").limit(n) for k, n in most.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["kind"], r["hash"], r["part"], r["spans"]) for b in batches for r in b.to_pylist())
        rows = [(k, part, [tuple(s[i : i + 3]) for i in range(0, len(s), 3)]) for k, _, part, s in rows]
        if any(k >= 0 for k, _, _ in rows):
            model = Tagger(TAGS, _BANNED)
            model.train(batches_of(rows))
            yield pa.record_batch([pa.array([zlib.compress(pickle.dumps(model), 1)], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(tidy(run), "model binary").collect()
    return bytes(made[0]["model"]) if made else None


@lru_cache(maxsize=1)
def _unpacked(packed: bytes) -> Tagger:
    return pickle.loads(zlib.decompress(packed))


def pieces(start: int, tags: np.ndarray, sure: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(start, end, kind, least marginal) of a window's spans, in the text's places."""
    at = np.flatnonzero(tags)
    i = 0
    while i < len(at):
        a = at[i]
        kind = (tags[a] - 1) // 2
        b = a + 1
        while b < len(tags) and tags[b] == 2 + 2 * kind:
            b += 1
        yield start + int(a), start + int(b), int(kind), float(sure[a:b].min())
        i = int(np.searchsorted(at, b))


def reconciled(length: int, found: list[tuple[int, list[tuple[int, int, int, float]]]]) -> list[tuple[int, int, int, float]]:
    """The text's spans from its windows' (window start, pieces): a piece cut by a window's edge joins the pieces of its kind that overlap
    or continue it; of what overlaps then, the set of most marginal-weighted characters is kept, the earlier one among equals."""
    whole, cut = [], []
    for start, own in found:
        end = min(length, start + WINDOW)
        for a, b, k, p in own:
            (cut if a == start and start > 0 or b == end and end < length else whole).append((a, b, k, p))
    for a, b, k, p in sorted(cut):
        joined = [(a, b, k, p)]
        others = [s for s in cut if s[2] == k and s[0] <= b and s[1] >= a]
        if not any(s[2] == k and s[0] <= a and s[1] >= b for s in whole):
            while len(others) > len(joined):
                joined = others
                a, b = min(s[0] for s in joined), max(s[1] for s in joined)
                others = [s for s in cut if s[2] == k and s[0] <= b and s[1] >= a]
            whole.append((a, b, k, min(s[3] for s in joined)))
    best: dict[tuple[int, int, int], float] = {}
    for a, b, k, p in whole:
        best[a, b, k] = max(p, best.get((a, b, k), 0.0))
    spans = sorted(((b, a, k, p) for (a, b, k), p in best.items()))
    ends, worth, took = [s[0] for s in spans], [0.0], []
    for n, (b, a, k, p) in enumerate(spans):
        before = bisect_right(ends, a, 0, n)
        gain = worth[before] + p * (b - a)
        took.append(before if gain > worth[n] else -1)
        worth.append(max(gain, worth[n]))
    out, n = [], len(spans)
    while n:
        if took[n - 1] >= 0:
            b, a, k, p = spans[n - 1]
            out.append((a, b, k, p))
            n = took[n - 1]
        else:
            n -= 1
    return out[::-1]


def added_spans(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, list]]) -> list[tuple[int, int, int]]:
    """The reconciled spans that may be added to a text's base spans."""
    out = []
    for a, b, k, p in reconciled(len(text), found):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        free = all(b <= x or a >= z for x, _, z in base)
        alone = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        if p >= SURE and free and alone and a < b and _undisguised(k, text[a:b]):
            out.append((a, k, b))
    return out


def tagged(model: Tagger, texts: list[str]) -> list[list[tuple[int, list]]]:
    """(window start, pieces) of every text's marked windows."""
    jobs = [(n, start) for n, text in enumerate(texts) for start in marked_windows(text)]
    out: list[list] = [[] for _ in texts]
    for first in range(0, len(jobs), BATCH):
        part = jobs[first : first + BATCH]
        ids = np.zeros((len(part), WINDOW), np.int64)
        for row, (n, start) in enumerate(part):
            window = classes(texts[n][start : start + WINDOW])
            ids[row, : len(window)] = window
        tags, sure = model.decode(ids)
        for row, (n, start) in enumerate(part):
            size = min(WINDOW, len(texts[n]) - start)
            own = list(pieces(start, tags[row, :size], sure[row, :size]))
            if own:
                out[n].append((start, own))
    return out


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added), n_added of every row."""
    learnt = learn(docs.select(F.col(text_col).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(learnt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            found = tagged(_unpacked(packed), texts) if packed else [[]] * len(texts)
            added = [added_spans(t, b, f) if f else [] for t, b, f in zip(texts, base, found)]
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
            yield pa.record_batch([batch.column(0), *counts, pa.array(digests), pa.array([written(sorted(b + a)) for b, a in zip(base, added)]), pa.array([len(a) for a in added], pa.int64())], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), _SCHEMA)
