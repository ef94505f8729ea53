"""Evaluation texts leaking into training text (problem 9): spaced-seed hashing and verified overlaps.

Words are hashed under fixed masks that ignore some positions, so a replaced word doesn't hide a passage.  The
seeds of the test items are a table; a Bloom filter of them, of bounded size, tells each task which windows of
a document can be seeds at all, and documents with such windows are joined with the table on the seed.  Each
pair of document and item that share seeds is verified: stretches of aligned words are collected along the
seeds' diagonals, chained in the item's order, and the item's covered share is measured.  The texts themselves
are never shuffled, only the hashes of words of documents that have seeds.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.session import checkpointed, small_or_shuffled

#: Masks over word positions and over characters of scripts without spaces.
WORD_MASKS = ["11111", "111011", "1101101", "1011011"]
CHAR_MASKS = ["11111111", "1110110111"]
#: Agreeing tokens and width of a dense stretch, and foreign tokens between two chained ones.
WORDS, CHARS = ((6, 8), 60), ((10, 12), 80)
#: Bits of the seed filter per seed, and in all at most (64 MB); a fuller filter only lets more through.
BITS_PER_SEED, MOST_BITS = 256, 1 << 29
#: Tokens of an item per seed that a leak has at least.  Where every fourth word differs, the most that a dense
#: stretch bears, seeds of one mask still come once per three agreeing words, which at a share of two fifths is
#: more than one per eight words of the item.  Items of fewer than SHORT tokens need one seed, others two or more.
PER_SEED, SHORT = 10, 20
#: Share of an item that must stand in a document.
SHARE = 0.4
_SPACELESS = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_CJK = re.compile(f"[{_SPACELESS}]")
_WORD = re.compile(r"\w+")
_MOJIBAKE = re.compile("[ÃÂâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ]")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def plain(text: str) -> str:
    """Text without what differs between writings of the same words: case, accents, entities, wrong decoding."""
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if _MOJIBAKE.search(text):
        for coding in ("cp1252", "latin-1"):
            fixed = re.sub(r"[^\x00-\x7f]+", lambda m: _redecode(m.group(), coding), text)
            if fixed != text:
                text = fixed
                break
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).replace("­", "").replace("​", "")
        if not text.isascii():
            text = "".join(c for c in text if not unicodedata.combining(c))
    return text.casefold()


def _redecode(s: str, coding: str) -> str:
    try:
        return s.encode(coding).decode("utf-8")
    except UnicodeError:
        return s


def _seeds(ids: np.ndarray, masks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each window of the tokens under each mask."""
    out, at = [], []
    for k, mask in enumerate(masks):
        n = len(ids) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, 2 * k + len(masks), np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                h = (h ^ ids[i : i + n]) * _PRIME
                h ^= h >> np.uint64(29)
        out.append(h)
        at.append(np.arange(n, dtype=np.int32))
    return (np.concatenate(out), np.concatenate(at)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def word_ids(text: str) -> np.ndarray:
    """Hash of each word of a plain text."""
    words = _WORD.findall(text)
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def char_ids(text: str) -> np.ndarray:
    """Code point of each letter and figure of a plain text."""
    return np.frombuffer("".join(c for c in text if c.isalnum()).encode("utf-32-le"), np.uint32).astype(np.uint64)


def item_tokens(text: str) -> tuple[bool, np.ndarray]:
    """Whether an item is measured in characters, and its tokens."""
    t = plain(text)
    letters = [c for c in t if c.isalnum()]
    chars = bool(letters) and sum(map(bool, map(_CJK.match, letters))) >= 0.5 * len(letters)
    return chars, char_ids(t) if chars else word_ids(t)


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places in a filter of 2**bits bits."""
    shift = np.uint64(64 - bits)
    return [(h >> shift).astype(np.int64), ((h * _MIX[0]) >> shift).astype(np.int64), ((h * _MIX[1]) >> shift).astype(np.int64)]


def _known(h: np.ndarray, at: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and positions that may be seeds."""
    for k in range(3):
        p = ((h if k == 0 else h * _MIX[k - 1]) >> np.uint64(64 - bits)).astype(np.int64)
        ok = (table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        h, at = h[ok], at[ok]
    return h, at


def covered(item: np.ndarray, doc: np.ndarray, along: np.ndarray, dense: tuple[int, int], margin: int) -> float:
    """Largest share of ``item`` that stands in ``doc`` in order and close together.

    Along each of the diagonals ``along`` the positions count that lie in dense stretches (at least so many of so many tokens
    agree); stretches are chained if they follow in both texts, with at most ``margin`` foreign tokens
    between two of them and twice the item plus the margin in all.
    """
    length, (need, wide) = len(item), dense
    need = min(need, length)
    pieces: list[tuple[int, int, int, np.ndarray]] = []  # first and last item position, diagonal, agreeing positions
    for d in np.unique(along):
        i0, i1 = max(0, -d), min(length, len(doc) - d)
        if i1 - i0 < need:
            continue
        same = item[i0:i1] == doc[i0 + d : i1 + d]
        c = np.concatenate([[0], np.cumsum(same)])
        n = len(same)
        if n <= wide:
            good = np.full(n, c[-1] >= need)
        else:
            window = (c[wide:] - c[:-wide]) >= need
            good = np.convolve(window, np.ones(wide, int)) > 0
        at = np.nonzero(good & same)[0]
        if not len(at):
            continue
        for run in np.split(at, np.nonzero(np.diff(at) > wide)[0] + 1):
            if len(run) >= need:
                pieces.append((int(run[0] + i0), int(run[-1] + i0), int(d), run + i0))
    pieces.sort(key=lambda p: (p[1] + p[2], p[1]))
    ends, lasts, counts, starts = [], [], [], []
    for a, b, d, run in pieces:
        count, start = len(run), a + d
        # a stretch before this one ends at most the margin before it begins; all of these are looked at
        for q in range(bisect_left(ends, a + d - margin), len(ends)):
            if b <= lasts[q] or counts[q] + len(run) <= count:
                continue
            fresh = len(run) - int(np.searchsorted(run, max(lasts[q], ends[q] - d), "right"))
            gap = max(a, lasts[q] + 1) + d - ends[q]
            if fresh and counts[q] + fresh > count and gap <= margin and b + d - starts[q] <= 2 * length + margin:
                count, start = counts[q] + fresh, starts[q]
        ends.append(b + d)
        lasts.append(b)
        counts.append(count)
        starts.append(start)
    return max(counts, default=0) / length


def diagonals(item: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Differences of document and item position along which at least ``least`` tokens agree."""
    order = np.argsort(item, kind="stable")
    left, right = np.searchsorted(item[order], doc, "left"), np.searchsorted(item[order], doc, "right")
    n = right - left
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
    d = np.repeat(np.arange(len(doc)), n) - order[k]
    return np.nonzero(np.bincount(d + len(item), minlength=1) >= max(1, least))[0] - len(item)


def needed(length: int) -> int:
    """Seeds at different places that a leaked item of so many tokens has in the document, at least."""
    return 1 if length < SHORT else max(2, length // PER_SEED)


def share_of(item: np.ndarray, doc: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray, chars: bool, least: float = 0.0) -> float:
    """Largest share of ``item`` that stands in ``doc``, given the positions of their common seeds.

    Shares below ``least`` may come out as 0.
    """
    dense, margin = CHARS if chars else WORDS
    order = np.argsort(doc_at, kind="stable")
    doc_at, item_at = doc_at[order].astype(np.int64), item_at[order].astype(np.int64)
    need = needed(len(item))
    reach = 2 * len(item) + margin  # a passage spreads over no more, so seeds further apart are measured apart
    best = 0.0
    for part in np.split(np.arange(len(doc_at)), np.nonzero(np.diff(doc_at) > reach)[0] + 1):
        if len(part) < need or len(np.unique(item_at[part])) < need:
            continue
        low, high = max(0, int(doc_at[part[0]]) - len(item)), int(doc_at[part[-1]]) + len(item) + margin
        near = doc[low:high]
        most = np.isin(item, near).mean()  # no more than its tokens that stand there at all
        if most < least or most <= best:
            continue
        best = max(best, covered(item, near, diagonals(item, near, min(dense[0], len(item))), dense, margin))
    return best


_ITEM = "item_id long, chars boolean, n int, ids binary, h array<long>, at array<int>"
_DOC = "doc_id long, chars boolean, ids binary, h array<long>, at array<int>"


def _item_rows(batches):
    for b in batches:
        rows = []
        for i, t in zip(b["i"], b["t"]):
            chars, ids = item_tokens(t)
            if len(ids):
                h, at = _seeds(ids, CHAR_MASKS if chars else WORD_MASKS)
                rows.append((i, chars, len(ids), ids.tobytes(), h.view(np.int64), at))
        yield pd.DataFrame(rows, columns=["item_id", "chars", "n", "ids", "h", "at"])


def _filter_bits(bits: int):
    def run(batches):
        for b in batches:
            h = np.concatenate(b["h"].to_numpy()).view(np.uint64) if len(b) else np.zeros(0, np.uint64)
            yield pd.DataFrame({"bit": np.unique(np.concatenate(_bits(h, bits)))})

    return run


def _doc_rows(table, bits: int, least: int, any_chars: bool):
    def run(batches):
        bitmap = np.frombuffer(table.value, np.uint8)
        for b in batches:
            rows = []
            for doc, text in zip(b["d"], b["t"]):
                t = plain(text)
                for chars in (False, True) if any_chars and _CJK.search(t) else (False,):
                    ids = char_ids(t) if chars else word_ids(t)
                    h, at = _known(*_seeds(ids, CHAR_MASKS if chars else WORD_MASKS), bitmap, bits)
                    if len(h) >= least:
                        rows.append((doc, chars, ids.tobytes(), h.view(np.int64), at))
            yield pd.DataFrame(rows, columns=["doc_id", "chars", "ids", "h", "at"])

    return run


def _verify(share: float):
    def run(batches):
        for b in batches:
            rows = []
            for doc, chars, ids, item_id, item_ids, doc_at, item_at in b[["doc_id", "chars", "ids", "item_id", "item_ids", "doc_at", "item_at"]].itertuples(index=False, name=None):
                s = share_of(np.frombuffer(item_ids, np.uint64), np.frombuffer(ids, np.uint64), doc_at, item_at, chars, share)
                if s >= share:
                    rows.append((doc, item_id, s))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, share: float = SHARE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, share): each document with each item of which at least ``share`` stands in it.

    The words (characters in scripts without spaces) must stand in the item's order and close together; case,
    accents, entities, punctuation and line breaks don't matter, and some words may differ.  NULL and empty
    documents and items, and items without an id, leak nothing.  Repeated rows are reported once; items with the
    same text are all reported.  There may be any number of items; documents and items are read whole.  A document
    and an item are compared if they share one seed per ten tokens of the item, at least two, one for items of fewer
    than 20 tokens; an item of fewer than five words (eight characters) has no seed and is never reported.
    """
    spark = documents.sparkSession
    rows = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    rows = checkpointed(rows.mapInPandas(_item_rows, _ITEM))
    n_seeds, shortest, any_chars = rows.agg(F.coalesce(F.sum(F.size("h")), F.lit(0)), F.min("n"), F.coalesce(F.max("chars"), F.lit(False))).first()
    bits = int(min(MOST_BITS, max(1 << 20, BITS_PER_SEED * n_seeds)) - 1).bit_length()
    found = rows.mapInPandas(_filter_bits(bits), "bit long").select(F.col("bit").alias("bit"), F.shiftright("bit", 15).alias("page"))
    pages = found.groupBy("page").agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32_767)).alias("map"))
    bitmap = bytearray(1 << (bits - 3))  # at most MOST_BITS in all
    for r in pages.toLocalIterator():
        bitmap[r.page << 12 : (r.page + 1) << 12] = r["map"]
    shared = spark.sparkContext.broadcast(bytes(bitmap))
    least = 1 if shortest is not None and shortest < SHORT else 2
    x = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    docs = checkpointed(x.mapInPandas(_doc_rows(shared, bits, least, bool(any_chars)), _DOC).withColumn("key", F.xxhash64("doc_id", "ids")))
    # documents' seeds meet the items' on the seed; of a seed that many items have, its list is one row
    postings = rows.select("item_id", "chars", "n", F.explode(F.arrays_zip("h", "at")).alias("s")).groupBy("chars", F.col("s.h").alias("h")).agg(F.collect_list(F.struct("item_id", F.col("s.at").alias("at"), "n")).alias("p"))
    seeds = docs.select("doc_id", "key", "chars", F.explode(F.arrays_zip("h", "at")).alias("s")).select("doc_id", "key", "chars", F.col("s.h").alias("h"), F.col("s.at").alias("doc_at"))
    hits = seeds.join(small_or_shuffled(postings), ["chars", "h"]).select("doc_id", "key", "chars", "doc_at", F.explode("p").alias("p"))
    pairs = hits.groupBy("doc_id", "key", "chars", "p.item_id", "p.n").agg(F.collect_set(F.struct("doc_at", F.col("p.at").alias("item_at"))).alias("at")).where(F.size(F.array_distinct("at.item_at")) >= F.when(F.col("n") < SHORT, 1).otherwise(F.greatest(F.lit(2), F.floor(F.col("n") / PER_SEED))))
    pairs = pairs.select(F.col("doc_id").alias("p_id"), F.col("key").alias("p_key"), F.col("chars").alias("p_chars"), "item_id", F.col("at.doc_at").alias("doc_at"), F.col("at.item_at").alias("item_at"))
    texts = rows.select(F.col("item_id").alias("i_id"), F.col("ids").alias("item_ids"))
    pairs = pairs.join(small_or_shuffled(texts), F.col("item_id") == F.col("i_id"))
    on = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("key") == F.col("p_key")) & (F.col("chars") == F.col("p_chars"))
    both = docs.join(pairs, on).select("doc_id", "chars", "ids", "item_id", "item_ids", "doc_at", "item_at")
    return both.mapInPandas(_verify(share), "doc_id long, item_id long, share double").groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
