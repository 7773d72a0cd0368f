"""Evaluation texts that leaked into training text.

The words of every item, and its runs of a few words, are normalised to letters
and digits without case, and the runs of all items make one Aho-Corasick
automaton.  A document is normalised likewise and scanned once; each hit is an
exact run and is extended to both sides word by word, allowing changed, missing
and added words, until no passage that is long enough can contain it.  Offsets
are mapped back to the original text.

A passage counts if it has at least ``min_words`` consecutive words of the item
(``min_chars`` characters in scripts without spaces), or is the whole item, and
at most one word in ``tolerance`` is changed, left out or put in.  With this
rule an undisturbed run of ``SEED_WORDS`` words (``SEED_CHARS`` characters) is
in every passage, so the scan misses none.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS, MIN_CHARS, TOLERANCE = 15, 30, 8
#: ceil(14 / 3) words: 16 words with two changes are the worst case; in
#: characters ceil(28 / 5), 32 with four changes.
SEED_WORDS, SEED_CHARS = 5, 6
#: So many items make one automaton; more items are scanned for in blocks.
ITEMS_PER_BLOCK = 20_000

_DROP = re.compile(r"[\W_]+")
_TOKEN = re.compile(r"\S+")
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿]")
_ASCII_DROP = bytes(i for i in range(128) if not chr(i).isalnum())
_ASCII_LOWER = bytes(ord(chr(i).lower()) if i < 128 else i for i in range(256))
_built: dict = {}


def normalise(text: str) -> str:
    """Letters and digits of a text in compatibility form without case."""
    if text.isascii():
        return text.encode().translate(_ASCII_LOWER, _ASCII_DROP).decode()
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _DROP.sub("", text.casefold())


class Item:
    """Words of an item and the shortest passage that counts."""

    __slots__ = ("id", "words", "least", "chars")

    def __init__(self, item_id: int, text: str) -> None:
        self.id = item_id
        flat = normalise(text)
        self.chars = len(_UNSPACED.findall(flat)) * 2 > len(flat)
        self.words = list(flat) if self.chars else [w for w in (normalise(t) for t in text.split()) if w]
        self.least = min(len(self.words), MIN_CHARS if self.chars else MIN_WORDS)

    def seed_words(self) -> int:
        n = len(self.words)
        if n >= (MIN_CHARS if self.chars else MIN_WORDS):
            return SEED_CHARS if self.chars else SEED_WORDS
        k = n // TOLERANCE  # a shorter item must be there as a whole
        return max(1, -(-(n - k) // (k + 1)))


class Matcher:
    """The automaton over the runs of all items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.items = [x for x in (Item(i, t) for i, t in items if t) if x.words]
        self.tree = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int, int]]] = {}
        for k, item in enumerate(self.items):
            w = item.seed_words()
            for a in range(len(item.words) - w + 1):
                places.setdefault("".join(item.words[a : a + w]), []).append((k, a, w))
        for run, at in places.items():
            self.tree.add_word(run, (len(run), tuple(at)))
        if places:
            self.tree.make_automaton()
        self.any = bool(places)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, words of the passage, start and end in the text)."""
        if not self.any or next(self.tree.iter(normalise(text)), None) is None:
            return []
        spans, starts, parts, at = [], [], [], 0
        for m in _TOKEN.finditer(text):
            w = normalise(m.group())
            if w:
                spans.append(m.span())
                starts.append(at)
                parts.append(w)
                at += len(w)
        flat = "".join(parts)
        doc = _Doc(flat, starts)
        best: dict[int, tuple[int, int, int, int]] = {}
        tried: dict[tuple[int, int], int] = {}
        for end, (size, at_items) in self.tree.iter(flat):
            begin = end + 1 - size
            for k, a, w in at_items:
                item = self.items[k]
                if item.id in best:
                    continue
                # seeds inside a run that was extended before give nothing new
                line = (k, begin - sum(map(len, item.words[:a])) if not item.chars else begin - a)
                if tried.get(line, -1) >= end:
                    continue
                got = doc.passage(item, a, w, begin)
                tried[line] = max(got[3], end)
                if got[0]:
                    lo, hi = got[1], got[2]
                    s = spans[bisect_right(starts, lo) - 1][0]
                    e = spans[max(0, bisect_left(starts, hi) - 1)][1]
                    best[item.id] = (item.id, got[0], s, e)
        return list(best.values())


class _Doc:
    """A normalised document and the starts of its words."""

    def __init__(self, flat: str, starts: list[int]) -> None:
        self.flat, self.starts, self.n = flat, starts, len(flat)
        self.borders = {*starts, self.n}

    def _next(self, p: int, chars: bool) -> int:
        if chars:
            return min(p + 1, self.n)
        i = bisect_right(self.starts, p)
        return self.starts[i] if i < len(self.starts) else self.n

    def _prev(self, p: int, chars: bool) -> int:
        if chars:
            return max(p - 1, 0)
        i = bisect_left(self.starts, p) - 1
        return self.starts[i] if i >= 0 else 0

    def passage(self, item: Item, a: int, w: int, begin: int) -> tuple[int, int, int, int]:
        """(words or 0, from, to, end of the exact run) around a seed."""
        words, n = item.words, len(item.words)
        # a passage of twice the least size has a half with as few changes for
        # its size, so that changes beyond those of a shorter one need no look
        most = min(n, 2 * (MIN_CHARS if item.chars else MIN_WORDS) + 1) // TOLERANCE
        i, p = a + w, begin + sum(map(len, words[a : a + w]))
        right, run_end = self._extend(words, i, p, most, item.chars, 1)
        left, _ = self._extend(words, a, begin, most, item.chars, -1)
        for el, (il, pl) in enumerate(left):
            for er, (ir, pr) in enumerate(right):
                size = ir - il
                if TOLERANCE * (el + er) > size:
                    continue  # more words on the right may pay for their changes
                if size >= item.least:
                    return size, pl, pr, run_end
        return 0, 0, 0, run_end

    def _extend(self, words: list[str], i: int, p: int, most: int, chars: bool, step: int) -> tuple[list[tuple[int, int]], int]:
        """Furthest (word, place) with 0, 1, ... changes; and where the exact
        run from the start ends."""
        flat, n = self.flat, len(words)

        def run(i: int, p: int) -> tuple[int, int]:
            i0, p0 = i, p
            if step > 0:
                while i < n and flat.startswith(words[i], p):
                    p += len(words[i])
                    i += 1
                while i > i0 and not chars and p not in self.borders:
                    i -= 1
                    p -= len(words[i])
            else:
                while i > 0 and p >= len(words[i - 1]) and flat.startswith(words[i - 1], p - len(words[i - 1])):
                    i -= 1
                    p -= len(words[i])
                while i < i0 and not chars and p not in self.borders:
                    p += len(words[i])
                    i += 1
            return (i, p) if (i0, p0) != (i, p) else (i0, p0)

        states = {run(i, p)}
        first = next(iter(states))
        far = [first]
        edge = n if step > 0 else 0
        for _ in range(most):
            new = set()
            for i, p in states:
                q = self._next(p, chars) if step > 0 else self._prev(p, chars)
                if i != edge:
                    new.add((i + step, p))
                    if q != p:
                        new.add((i + step, q))
                if q != p:
                    new.add((i, q))
            states = {run(*x) for x in new} if new else states
            lines: dict[int, tuple[int, int]] = {}
            for i, p in states:  # of the states on one diagonal only the furthest counts
                d = i - (p if chars else bisect_left(self.starts, p))
                if d not in lines or step * i > step * lines[d][0]:
                    lines[d] = (i, p)
            states = set(lines.values())
            top = max(states, key=lambda x: (step * x[0], step * x[1]))
            far.append(top if step * top[0] > step * far[-1][0] else far[-1])
            if top[0] == edge:
                break
        return far, first[1]


def find_leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """Columns item_id, doc_id, words, start_pos, end_pos of leaked passages.

    One row for each item and document; the passage is the first that counts,
    with its offsets in the original text.  Null and empty texts leak nothing;
    an item stored twice counts once; a document stored twice gives two rows.
    Items are read in blocks of ``block``, so that the automaton is bounded.
    """
    rows = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct()
    sc = documents.sparkSession.sparkContext
    n_blocks = max(1, -(-rows.count() // block))
    out_schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("words", T.IntegerType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])
    source = documents.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    found = None
    for b in range(n_blocks):
        mine = rows.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == b)
        shared = sc.broadcast(sorted((r[0], r[1]) for r in mine.toLocalIterator()))
        part = source.mapInArrow(_scanner(shared, out_schema), out_schema)
        found = part if found is None else found.unionByName(part)
    return found


def _scanner(shared, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        key = hash(tuple(items))
        if key not in _built:
            _built.clear()
            _built[key] = Matcher(items)
        matcher = _built[key]
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for item, words, s, e in matcher.find(t) if t else ():
                    for c, v in zip(out, (item, d, words, s, e)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return scan
