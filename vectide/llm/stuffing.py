"""Pages of repeated keywords, link lists or product tags instead of sentences.

1. *Common words* are counted, not listed: a word is common if it stands in
   ``common_share`` of the pages of a language. Counts are over all pages; languages
   with under one page in a hundred have none of their own. The words that come back
   are bounded by the mean number of different words of a page over ``common_share``,
   for each of at most a hundred languages.
2. Every text is read whole and cut into units (lines and sentences). A unit is a
   *sentence* if it has five words or more, some of them common, and ends like one (or
   is long, richer in common words and not cut up by separators); in ideographs if it
   ends like one and its clauses are of some length. Every other unit is *list*, and so
   are the characters of links.
3. *Keywords* of a page are words that its sentences say again within themselves, twice
   or more in all (two ideographs are a word); sentences made of them for
   ``KEYWORD_DENSE`` or more are as dense as lists. The **list density** of a page is
   the share of its characters in lists, links and such sentences.
4. **Phrase shingles**: every run of five words (stride 1) of every unit of every page;
   in lists, of every item. What a page fills into its phrases is a slot: links, words
   with digits, keywords in sentences, words that a page's lists and dense sentences say
   again; of an item or such a sentence the words said once are left out. So "24h oat husk Norwick" and
   "24h rye bran Dunmouth" are one phrase, which is what a stitched page consists of.
5. The distinct hosts of each phrase are counted exactly over the whole collection: a
   task sends at most ``min_hosts + 1`` hosts of a phrase, phrases go to buckets by
   hash. The **stitched share** of a page is that of its words in phrases that stand on
   more than ``min_hosts`` hosts.
6. A page is flagged if its list density is over ``density`` and its stitched share
   ``stitched_share`` or more. Neither does it alone: prose is copied over hosts too
   (density near 0), and a list of its own is no spam (nothing stitched).

Semantics: null, empty and short texts (under ``MIN_CHARS``) and wrongly decoded
ones are no cases. A null host is a host of its own, a null language a language. A
repeated id is one page if its rows are equal. Phrases are told apart by 48-bit
hashes. No rows give no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string as _parse

from vectide.shared import stored

MIN_CHARS = 80
#: Share of a sentence's words that makes it one of keywords.
KEYWORD_DENSE = 0.15
#: Words a link counts for in the stitched share.
LINK_WORDS = 8
#: Words of a run of keywords that are one slot at most.
SLOT_WORDS = 8
#: Languages of a smaller share of the pages have no common words of their own.
LEAST_LANGUAGE = 0.01

_CJK = re.compile(r"[㐀-鿿]")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*")
_HERE = "\x00"
_WORD = re.compile(r"\x00|[㐀-鿿]|[^\W㐀-鿿]+(?:['’_-][^\W㐀-鿿]+)*")
_RUN = re.compile(r"[㐀-鿿]+|[^\W㐀-鿿]+(?:['’_-][^\W㐀-鿿]+)*")
_UNIT = re.compile(r"[\r\n]+|(?<=[.!?])\s+|(?<=[。！？])")
_ENDS = re.compile(r"[.!?。！？:：;；…][\"'”’»）)\]]*\s*$")
_SEPARATOR = re.compile(r"[,，、;；·•|»>/#*\r\n!?。！？\x00]+|\s-\s|\.\s|\s{2,}")
_CLAUSE = re.compile(r"[,，、;；·•|»>/#*。！？.!?\s\x00]+")
_LATIN = "".join(map(chr, range(0x80, 0xC0))) + "åæçäèéï"


def damaged(text: str) -> bool:
    """Wrongly decoded: a fifth or more of the characters are those of bytes read as Latin-1."""
    return 5 * sum(map(text.count, _LATIN)) >= len(text) if any(c in text for c in "åæçäèéï") else False


def common_words(rows: DataFrame, common_share: float) -> frozenset[str]:
    """Words in ``common_share`` of the pages of a language, of (``lang``, ``t``) over all pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = pages.setdefault(lang, Counter())
                mine.update({w for w in text.lower().split() if w.isalpha() and not _CJK.match(w)})
                mine[""] += 1
        for lang, words in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    counted = rows.select("lang", "t").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "stuffed-words")  # read three times
    pages = counted.where("word = ''").select("lang", F.col("n").alias("pages"))
    total = pages.agg(F.sum("pages")).first()[0] or 0
    large = pages.where(F.col("pages") >= LEAST_LANGUAGE * total)  # a hundred languages at most
    common = counted.where("word != ''").join(large, "lang").where(F.col("n") >= common_share * F.col("pages"))
    return frozenset(r.word for r in common.select("word").distinct().toLocalIterator())


class _Hashes(dict):
    """Hashes of words; bit 0: a content word, bit 1: an ideograph, bit 2: a common word. The first million are kept."""

    def __init__(self, common: frozenset[str]):
        self.common = common

    def __missing__(self, word: str) -> int:
        if word == _HERE:
            return LINK
        if any(c.isdigit() for c in word):
            return NUMBER
        single, common = len(word) == 1 and bool(_CJK.match(word)), word in self.common
        value = xxhash.xxh3_64_intdigest(word) & ~7 | (not single and not common and len(word) > 1) | single << 1 | common << 2
        if len(self) < 1 << 20:
            self[word] = value
        return value


SLOT, LINK, NUMBER = (xxhash.xxh3_64_intdigest(x) & ~7 for x in ("\x00slot", "\x00link", "\x00number"))
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CONTENT, _IDEOGRAPH, _COMMON = np.uint64(1), np.uint64(2), np.uint64(4)
ITEM, SENTENCE = 0, 1


def is_sentence(rest: str, words: list[str], common: frozenset[str]) -> bool:
    """Whether a unit reads as a sentence; ``rest`` has a mark for each link."""
    ideographs = 0 if rest.isascii() else len(_CJK.findall(rest))
    if ideographs * 3 > len(rest):
        clauses = [len(c) for c in _CLAUSE.split(rest) if _CJK.search(c)]  # numbers apart
        return ideographs >= 8 and sum(clauses) >= 7 * len(clauses) and _ENDS.search(rest) is not None
    n = len(words)
    if n < 5:
        return False
    share = sum(map(common.__contains__, words)) / n
    if share >= 0.09 and _ENDS.search(rest):
        return True
    return n >= 12 and share >= 0.2 and n >= 5 * sum(1 for c in _SEPARATOR.split(rest) if c and not c.isspace())


class Page(NamedTuple):
    """The words of all units one behind another, with the units' numbers of words, kinds
    and characters; the characters of lists and links, and of all."""

    words: list[str]
    lengths: list[int]
    kinds: list[int]
    sizes: list[int]
    listed: int
    total: int


def page_units(text: str | None, common: frozenset[str]) -> Page | None:
    """The units of a page; None if it is no case."""
    if text is None or len(text) < MIN_CHARS or damaged(text):
        return None
    every: list[str] = []
    lengths, kinds, sizes, listed, total = [], [], [], 0, 0
    linked = "/" in text or "www." in text  # no link is without
    for unit in _UNIT.split(text):
        if not unit or unit.isspace():
            continue
        rest = _LINK.sub(_HERE, unit) if linked else unit
        total += len(unit)
        low = rest.lower()
        words = _WORD.findall(low)
        if is_sentence(rest, words, common):
            listed += len(unit) - len(rest)
            every += words
            lengths.append(len(words))
            kinds.append(SENTENCE)
            sizes.append(len(rest))
            continue
        listed += len(unit)
        for item in _SEPARATOR.split(low):
            words = _RUN.findall(item)
            if words:
                every += words
                lengths.append(len(words))
                kinds.append(ITEM)
                sizes.append(0)
        links = low.count(_HERE)
        every += [_HERE] * links
        lengths += [1] * links
        kinds += [ITEM] * links
        sizes += [0] * links
    return Page(every, lengths, kinds, sizes, listed, total)


def _said_again(keys: np.ndarray) -> np.ndarray:
    """Which keys occurred before (in any order, all occurrences but one)."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out


def sentence_keywords(words: np.ndarray, unit: np.ndarray, page: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Which words of sentences (``said``) are keywords of their page."""
    out = np.zeros(len(words), bool)
    at = np.flatnonzero(said & ((words & _CONTENT) > 0))
    pair = np.flatnonzero(said[:-1] & ((words[:-1] & words[1:] & _IDEOGRAPH) > 0) & (unit[:-1] == unit[1:])) if len(words) > 1 else np.zeros(0, np.int64)
    gram = np.concatenate([words[at], words[pair] * _MIX2 + words[pair + 1]])
    where = np.concatenate([at, pair])
    again = _said_again(gram + unit[where].astype(np.uint64) * _MIX)
    key = gram + page[where].astype(np.uint64) * _MIX
    values, times = np.unique(key[again], return_counts=True)
    hit = np.isin(key, values[times >= 2])
    out[where[hit]] = True
    out[where[hit & (np.arange(len(where)) >= len(at))] + 1] = True
    if len(words) > 2:  # "transport du bétail": a common word between two of them belongs to them
        out[1:-1] |= out[:-2] & out[2:] & ((words[1:-1] & _COMMON) > 0) & (unit[:-2] == unit[2:])
    return out


def list_slots(words: np.ndarray, unit: np.ndarray, page: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of lists and dense sentences (``listed``): those said again by their page's lists, and those
    said once that stand in an item with such a word."""
    at = np.flatnonzero(listed & ((words & _CONTENT) > 0))
    _, back, times = np.unique(words[at] + page[at].astype(np.uint64) * _MIX, return_inverse=True, return_counts=True)
    again = np.zeros(len(words), bool)
    again[at] = times[back] >= 2
    with_slot = np.bincount(unit[again], minlength=int(unit[-1]) + 1 if len(unit) else 0) > 0
    once = np.zeros(len(words), bool)
    once[at] = ~again[at] & with_slot[unit[at]]
    return again, once


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def shingles(words: np.ndarray, lengths: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hashes of all runs of five words (a shorter unit is one run), the unit of
    each, and its weight: that of the words which the run before it does not hold."""
    weights = np.ones(len(words), np.int64) if weights is None else weights
    wide = np.maximum(lengths, 5)
    starts = np.cumsum(wide) - wide
    at = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat, heavy = np.zeros(int(wide.sum()), np.uint64), np.zeros(int(wide.sum()), np.int64)
    flat[np.repeat(starts, lengths) + at] = words
    heavy[np.repeat(starts, lengths) + at] = weights
    runs = wide - 4
    unit = np.repeat(np.arange(len(lengths)), runs)
    ahead = np.arange(len(unit)) - np.repeat(np.cumsum(runs) - runs, runs)
    first = np.repeat(starts, runs) + ahead
    h = np.zeros(len(first), np.uint64)
    weight = heavy[first + 4] if len(first) else np.zeros(0, np.int64)
    for k in range(5):
        h = h * _MIX + flat[first + k]
        if k < 4:
            weight = weight + np.where(ahead == 0, heavy[first + k], 0)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(16), unit, weight


def _planes(values: np.ndarray) -> bytes:
    """Bytes by place, so that the equal high ones of sorted numbers compress."""
    return values.view(np.uint8).reshape(len(values), 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


class _Block:
    """Pages of a task until they are written: phrases by bucket, each with its hosts."""

    def __init__(self, buckets: int, min_hosts: int, density: float, common: frozenset[str], schema: pa.Schema):
        self.buckets, self.min_hosts, self.density, self.schema, self.hashes = buckets, min_hosts, density, schema, _Hashes(common)
        self.clear()

    def clear(self) -> None:
        self.hosts: dict[int, int] = {}
        self.phrases, self.cases, self.case_n, self.case_of, self.pages, self.size = [], [], [], [], [], 0

    def add(self, ids: list, hosts: list[str], pages: list[Page | None]) -> None:
        taken = [(i, h, p) for i, h, p in zip(ids, hosts, pages) if p is not None]
        if not taken:
            return
        count = sum(len(p.words) for *_, p in taken)
        words = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(p.words for *_, p in taken)), np.uint64, count)
        lengths, kinds, sizes = (np.fromiter(chain.from_iterable(getattr(p, c) for *_, p in taken), np.int64) for c in ("lengths", "kinds", "sizes"))
        unit_page = np.repeat(np.arange(len(taken)), [len(p.lengths) for *_, p in taken])
        unit = np.repeat(np.arange(len(lengths)), lengths)
        page, said = unit_page[unit], (kinds == SENTENCE)[unit]
        keyword = sentence_keywords(words, unit, page, said)
        # evidence of density
        dense = (np.bincount(unit[keyword], minlength=len(lengths)) >= KEYWORD_DENSE * lengths) & (kinds == SENTENCE)
        again, once = list_slots(words, unit, page, ~said | dense[unit])
        total = np.array([max(1, p.total) for *_, p in taken])
        list_share = np.array([p.listed for *_, p in taken]) / total
        keyword_share = np.bincount(unit_page, sizes * dense, len(taken)) / total
        # slots: a run of keywords of a sentence is one (a long one several), links weigh more
        weight = np.where(words == np.uint64(LINK), LINK_WORDS, 1)
        spoken = np.bincount(page, weight, len(taken))
        words[keyword | again] = SLOT
        slot = (keyword | again) & said
        follows = np.zeros(len(words), bool)
        follows[1:] = slot[1:] & slot[:-1] & (unit[1:] == unit[:-1])
        place = np.arange(len(words))
        place -= np.maximum.accumulate(np.where(follows, 0, place))
        kept = np.flatnonzero(~(follows & (place % SLOT_WORDS > 0)) & ~once)
        weight = np.where(once, 0, weight)
        weight = np.add.reduceat(weight, kept) if len(kept) else weight[:0]
        lengths = np.bincount(unit[kept], minlength=len(lengths))
        h, of, n = shingles(words[kept], lengths, weight)
        page = unit_page[of]
        filled = n > 0  # a unit left without words is none
        h, page, n = h[filled], page[filled], n[filled]
        host = np.array([self.hosts.setdefault(xxhash.xxh3_64_intdigest(x), len(self.hosts)) for _, x, _ in taken], np.uint64)
        value = (h << np.uint64(16)) | host[page]
        judged = list_share + keyword_share > self.density  # no number of hosts flags the others: they are counted, but need no share
        self.phrases.append(_distinct(value[~judged[page]]))
        number = np.cumsum(judged) - 1 + len(self.pages)
        self.pages += [(i, float(s), float(k), float(w)) for (i, *_), s, k, w, j in zip(taken, list_share, keyword_share, spoken, judged) if j]
        mine = judged[page]
        value, of, n = value[mine], number[page[mine]].astype(np.uint64), n[mine]
        order = np.lexsort((of, value))
        value, of, n = value[order], of[order], n[order]
        new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]))[: len(value)])
        self.cases.append(value[new])
        self.case_of.append(of[new])
        self.case_n.append((np.add.reduceat(n, new) if len(new) else n).astype(np.uint64))
        self.size += len(self.phrases[-1]) + len(new)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.phrases:
            return
        phrases = _distinct(np.concatenate(self.phrases))
        # more hosts of one phrase than can matter need not be sent
        enough = self.min_hosts + 1
        key = phrases >> np.uint64(16)
        phrases = phrases[np.append(np.ones(min(enough, len(key)), bool), key[enough:] != key[:-enough])]
        cases, of, n = map(np.concatenate, (self.cases, self.case_of, self.case_n))
        edges = np.array([(k << 64) // self.buckets for k in range(1, self.buckets)], np.uint64)
        bucket = np.searchsorted(edges, cases, "right")
        order = np.argsort(bucket, kind="stable")
        case_cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        cut = [0, *np.searchsorted(phrases, edges), len(phrases)]
        hosts = np.array(list(self.hosts), np.uint64)
        rows = []
        for b in range(self.buckets):
            part, mine = phrases[cut[b] : cut[b + 1]], order[case_cut[b] : case_cut[b + 1]]
            own = self.pages[b :: self.buckets]  # their evidence goes with this bucket
            if not len(part) and not len(mine) and not own:
                continue
            pages, local = np.unique(of[mine], return_inverse=True)
            both = np.concatenate([part, cases[mine]])
            index = (both & np.uint64(0xFFFF)).astype(np.int64)
            used = np.flatnonzero(np.bincount(index, minlength=len(hosts)))
            place = np.zeros(len(hosts), np.uint64)
            place[used] = np.arange(len(used))
            both = (both & ~np.uint64(0xFFFF)) | place[index]
            planes = map(_planes, (both[: len(part)], both[len(part) :], local.astype(np.uint64), n[mine]))
            rows.append((b, hosts[used].tobytes(), *planes, [self.pages[int(k)][0] for k in pages], *(map(list, zip(*own)) if own else [[]] * 4)))
            if len(rows) == 64:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)
        self.clear()

    def _batch(self, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)], schema=self.schema)


def _judge_bucket(min_hosts: int, schema: pa.Schema):
    """Of a bucket's phrases: for each judged page the words in those on enough hosts."""

    def run(table: pa.Table) -> pa.Table:
        keys, hosts, sent, number, counts, ids = [], [], [], [], [], []
        own = [[], [], [], []]
        for row in table.to_pylist():
            names = np.frombuffer(row["hosts"], np.uint64)
            case, tag = _numbers(row["cases"]), _numbers(row["tags"])
            for v in (case, _numbers(row["phrases"])):
                keys.append(v >> np.uint64(16))
                hosts.append(names[(v & np.uint64(0xFFFF)).astype(np.int64)])
            sent.append(case >> np.uint64(16))
            number.append(tag + np.uint64(len(ids)))
            counts.append(_numbers(row["counts"]))
            ids += row["ids"]
            for k, name in enumerate(("own_ids", "list_share", "keyword_share", "words")):
                own[k] += row[name]
        key, host, case, page, n = map(np.concatenate, (keys, hosts, sent, number, counts))
        wanted = np.isin(key, _distinct(case))
        key, host = key[wanted], host[wanted]
        order = np.lexsort((host, key))
        key, host = key[order], host[order]
        new = np.append(True, (key[1:] != key[:-1]) | (host[1:] != host[:-1]))[: len(key)]
        found, times = np.unique(key[new], return_counts=True)
        stitched = times[np.searchsorted(found, case)] > min_hosts if len(case) else np.zeros(0, bool)
        words = np.bincount(page[stitched].astype(np.int64), n[stitched], len(ids)).astype(np.int64)
        columns = [ids + own[0], *([None] * len(ids) + x for x in own[1:]), np.concatenate([words, np.zeros(len(own[0]), np.int64)])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


BLOCK_PHRASES = 4_000_000


def stuffed_pages(
    df: DataFrame,
    id_col: str,
    text: str,
    host: str,
    lang: str | None = None,
    min_hosts: int = 2,
    density: float = 0.6,
    stitched_share: float = 0.5,
    common_share: float = 0.3,
) -> DataFrame:
    """``id``, ``list_share``, ``keyword_share``, ``stitched_share`` and ``stuffed`` of every
    page whose list density (the sum of the first two) is over ``density``."""
    kind = dict(df.dtypes)[id_col]
    language = F.lower(F.coalesce(F.col(lang).cast("string"), F.lit(""))) if lang else F.lit("")
    own_host = F.coalesce(F.col(host), F.concat(F.lit("\x00"), F.col(id_col).cast("string")))
    rows = df.select(F.col(id_col).alias("id"), own_host.alias("host"), F.col(text).alias("t"), language.alias("lang")).where((F.length("t") >= MIN_CHARS) & F.col("id").isNotNull())
    common = common_words(rows, common_share)
    schema = f"bucket int, hosts binary, phrases binary, cases binary, tags binary, counts binary, ids array<{kind}>, own_ids array<{kind}>, list_share array<double>, keyword_share array<double>, words array<double>"
    result = f"id {kind}, list_share double, keyword_share double, words double, stitched bigint"
    arrow, arrow_result = to_arrow_schema(_parse(schema)), to_arrow_schema(_parse(result))
    buckets = max(128, 4 * rows.rdd.getNumPartitions())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(buckets, min_hosts, density, common, arrow)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                block.add(*(part.column(k).to_pylist() for k in (0, 1)), [page_units(t, common) for t in part.column(2).to_pylist()])
                if block.size >= BLOCK_PHRASES or len(block.hosts) >= 64_000:
                    yield from block.flush()
        yield from block.flush()

    parts = rows.drop("lang").mapInArrow(work, schema).groupBy("bucket").applyInArrow(_judge_bucket(min_hosts, arrow_result), result)
    out = parts.groupBy("id").agg(
        *(F.max(c).alias(c) for c in ("list_share", "keyword_share")), F.coalesce(F.try_divide(F.sum("stitched"), F.sum("words")), F.lit(0.0)).alias("stitched_share")
    )
    return out.withColumn("stuffed", (F.col("list_share") + F.col("keyword_share") > density) & (F.col("stitched_share") >= stitched_share))
