"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over word numbers of the normalised items, on the driver, in blocks of
bounded size, packed into flat arrays and broadcast. Documents are streamed through it word by
word: the state gives the longest stretch ending here that some item contains, so every window
of an item that stands in a document is seen, wherever it stands. If there are many blocks, a
task holds one of them at a time.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import shielded, travels

#: Consecutive item words that make a window.
WINDOW = 10
#: Most words of items in one automaton; more items make more automata.
BLOCK_WORDS = 1_000_000
#: Characters of the texts that are worked on at a time, one text at least.
CHUNK = 2_000_000
#: Blocks that a task keeps in memory; beyond, each is loaded anew for a batch of texts.
RESIDENT = 2
#: Bytes that are no part of a word become spaces, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

travels(__name__)


def item_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of items, with what each window length needs to know.

    After build: step[v] maps a word number to the next state, link and length are the suffix
    link and longest length; window_of[v] is the state of the last `window` words once that
    many match; owners[u] holds the item numbers of such a state; shorts[v] lists the (length,
    state) of whole items shorter than a window that end in v's stretch."""

    def __init__(self, items: list[list[bytes]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [[self.ids.setdefault(w, len(self.ids)) for w in words] for words in items]
        for words in dict.fromkeys(map(tuple, numbered)):
            last = 0
            for w in words:
                last = self._grow(last, w)
        self._know(numbered)

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of q whose longest stretch ends with p's."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _grow(self, last: int, w: int) -> int:
        if (q := self.step[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def _know(self, numbered: list[list[int]]) -> None:
        n, window = len(self.length), self.window
        order = sorted(range(n), key=self.length.__getitem__)
        self.window_of = [-1] * n
        for v in order[1:]:
            if self.length[v] >= window:
                up = self.link[v]
                self.window_of[v] = v if self.length[up] < window else self.window_of[up]
        self.owners: dict[int, set[int]] = {}
        whole: dict[int, int] = {}
        for k, words in enumerate(numbered):
            v = 0
            for w in words:
                v = self.step[v][w]
                if self.window_of[v] >= 0:
                    self.owners.setdefault(self.window_of[v], set()).add(k)
            if 0 < len(words) < window:
                whole[v] = len(words)
                self.owners.setdefault(v, set()).add(k)
        self.shorts: list[tuple[tuple[int, int], ...]] = [()] * n
        for v in order[1:]:
            up = self.shorts[self.link[v]]
            self.shorts[v] = ((whole[v], v), *up) if v in whole else up
        lengths = [min(len(words), window) for words in numbered if words]
        self.least = min(lengths, default=window)

    def packed(self) -> tuple:
        """The automaton as plain values, the fields of Packed: executors need no class of this
        library to unpickle it, and a state takes some thirty bytes."""
        n, width = len(self.length), len(self.ids)
        first, only_word, only_next, more = array("i", [-1]) * width, array("i", [-1]) * n, array("i", [-1]) * n, {}
        for v, step in enumerate(self.step):
            for w, q in step.items():
                if v == 0:
                    first[w] = q
                elif only_word[v] < 0:
                    only_word[v], only_next[v] = w, q
                else:
                    more[v * width + w] = q
        owner_at, owner_list = array("i", [0]), array("i")
        for v in range(n):
            owner_list.extend(sorted(self.owners.get(v, ())))
            owner_at.append(len(owner_list))
        shorts = {v: s for v, s in enumerate(self.shorts) if s}
        return (self.window, self.least, self.ids, first, only_word, only_next, more, array("i", self.link), array("i", self.length), array("i", self.window_of), shorts, owner_at, owner_list)


class Packed(NamedTuple):
    """first: the root's next states by word; only_word and only_next: one step of each other
    state; more: its other steps by state * words + word. Owners of v: owner_list from
    owner_at[v] to owner_at[v + 1]."""

    window: int
    least: int
    ids: dict[bytes, int]
    first: array
    only_word: array
    only_next: array
    more: dict[int, int]
    link: array
    length: array
    window_of: array
    shorts: dict[int, tuple[tuple[int, int], ...]]
    owner_at: array
    owner_list: array


def stream(packed: tuple, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans [start, end) of hit words, merged where they touch or overlap, and the states
    of the windows that occur."""
    window, least, ids, first, only_word, only_next, more, link, length, window_of, shorts, _, _ = packed
    numbers, width = list(map(ids.get, words)), len(ids)
    spans: list[list[int]] = []
    found: set[int] = set()
    at, n = 0, len(numbers)
    none = [i for i, x in enumerate(numbers) if x is None] if None in numbers else []
    for stop in (*none, n):
        if stop - at >= least:
            v = size = 0
            for j in range(at, stop):
                w = numbers[j]
                while v:
                    nxt = only_next[v] if only_word[v] == w else more.get(v * width + w, -1)
                    if nxt >= 0:
                        break
                    v = link[v]
                    size = length[v]
                else:
                    nxt = first[w]
                v, size = nxt, size + 1
                hit = 0
                if size >= window:
                    # the state of the last `window` words is v's or one above it
                    found.add(window_of[v])
                    hit = size
                if shorts and v in shorts:
                    for k, s in shorts[v]:
                        if k <= size:
                            found.add(s)
                            hit = max(hit, k)
                if hit:
                    start = j + 1 - hit
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1][1] = j + 1
                    else:
                        spans.append([start, j + 1])
        at = stop + 1
    return [(a, b) for a, b in spans], found


def _each(sent: list) -> Iterator[tuple]:
    """The blocks, one after the other; where there are many, none stays in memory."""
    for b in sent:
        yield b.value
        if len(sent) > RESIDENT:
            vars(b).pop("_value", None)


def _chunks(batches: Iterator[pa.Array]) -> Iterator[tuple[list[str | None], bool]]:
    """The texts in lists of CHUNK characters, and whether a list is the last of its batch."""
    for batch in batches:
        part, size = [], 0
        for t in batch:
            part.append(t.as_py())
            size += len(part[-1] or "")
            if size >= CHUNK:
                yield part, False
                part, size = [], 0
        yield part, True


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[tuple[list[str | None], list[list[bytes]]]]:
    """Ids and words of the items that have words, in blocks of at most so many words (an item
    that is longer makes its own)."""
    ids, lists, size = [], [], 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        if not (words := item_words(row["t"])):
            continue
        if lists and size + len(words) > block_words:
            yield ids, lists
            ids, lists, size = [], [], 0
        ids.append(row["i"])
        lists.append(words)
        size += len(words)
    yield ids, lists


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])


@shielded(["text"], ["out"])
def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with a struct column `out`: n_words, spans, items.

    spans are the [start, end) word numbers of the document's words that stand inside any
    occurrence of a window, merged; items are the ids (as strings, distinct, sorted) of items
    with a window that occurs. A window is `window` consecutive words of an item; an item of
    fewer words, but not none, is one window. Null texts have no words; items without an id
    hit, but have no id to list; repeated items count once. The automaton of a block is bounded
    by block_words; many items make several, each streamed in the same pass and, if they are
    more than RESIDENT, one at a time in memory. Texts are read whole, however long; an empty
    table gives an empty one, and without items nothing is hit.
    """
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast((ids, Automaton(lists, window).packed())) for ids, lists in _blocks(items, item_id, item_text, block_words)]

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes, spans, names = [], [], []
        for part, last in _chunks(batches):
            texts = [item_words(t) for t in part]
            hits, owners = [[] for _ in texts], [set() for _ in texts]
            for ids, packed in _each(sent):
                owner_at, owner_list = packed[-2:]
                for own, who, words in zip(hits, owners, texts, strict=True):
                    at, found = stream(packed, words)
                    own.append(at)
                    who.update(ids[k] for s in found for k in owner_list[owner_at[s] : owner_at[s + 1]])
            sizes += [len(w) for w in texts]
            spans += [merged(h) for h in hits]
            names += [sorted(o - {None}) for o in owners]
            if not last:
                continue
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string()))], ["n_words", "spans", "items"])
            sizes, spans, names = [], [], []

    return docs.withColumn(out, scan(F.col(text).cast("string")))


def merged(lists: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """One list of spans, joined where they touch or overlap."""
    if len(lists) == 1:
        return lists[0]
    out: list[tuple[int, int]] = []
    for a, b in sorted(x for spans in lists for x in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@shielded(["text", "n_chars"])
def remove_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS, n_chars: str | None = None) -> DataFrame:
    """docs without test items: spans of more than max_span hit words are cut out of the text,
    and documents that lose more than max_coverage of their words go.

    A cut takes the text from the first byte of a span's first word to the last byte of its
    last and leaves one line break. What then meets can make a window again, so cutting
    repeats until no span is over the limit. Other texts stay as they are, null too; texts of
    any length are read whole; repeated rows are treated alike; an empty table gives an empty
    one. Column `n_chars`, if named, is set to the code points of a changed text.
    """
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(Automaton(lists, window).packed()) for _, lists in _blocks(items, item_id, item_text, block_words)]

    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("keep", T.BooleanType())]))
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        done, keeps = [], []
        for texts, last in _chunks(batches):
            sizes, lost = [len(item_words(t)) for t in texts], [0] * len(texts)
            todo = [i for i, t in enumerate(texts) if t]
            while todo:
                words = [item_words(texts[i]) for i in todo]
                hits: list[list] = [[] for _ in todo]
                for packed in _each(sent):
                    for own, w in zip(hits, words, strict=True):
                        own.append(stream(packed, w)[0])
                again = []
                for i, own in zip(todo, hits, strict=True):
                    if spans := [s for s in merged(own) if s[1] - s[0] > max_span]:
                        lost[i] += sum(b - a for a, b in spans)
                        texts[i] = cut_words(texts[i], spans)
                        again.append(i)
                todo = again
            done += texts
            keeps += [k <= max_coverage * n for k, n in zip(lost, sizes, strict=True)]
            if not last:
                continue
            yield pa.StructArray.from_arrays([pa.array(done, pa.string()), pa.array(keeps, pa.bool_())], ["text", "keep"])
            done, keeps = [], []

    names = docs.columns
    # not deterministic, so that it isn't run once for the filter and again for the text
    done = docs.withColumn("_clean", clean.asNondeterministic()(F.col(text).cast("string"))).where("_clean.keep")
    if n_chars:
        done = done.withColumn(n_chars, F.when(F.col(text).eqNullSafe(F.col("_clean.text")), F.col(n_chars)).otherwise(F.char_length("_clean.text").cast(docs.schema[n_chars].dataType)))
    return done.withColumn(text, F.col("_clean.text")).select(*(F.col(f"`{c}`") for c in names))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the bytes of the words in spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(FOLD)
    out, kept, word, pos, n = [], 0, 0, 0, len(folded)
    wanted = iter(spans)
    span = next(wanted, None)
    start = 0
    while span is not None and pos < n:
        while pos < n and folded[pos] == 32:
            pos += 1
        if word == span[0]:
            start = pos
        end = folded.find(b" ", pos)
        pos = n if end < 0 else end
        word += 1
        if word == span[1]:
            out.append(raw[kept:start])
            kept = pos
            span = next(wanted, None)
    out.append(raw[kept:])
    return b"\n".join(out).decode("utf-8", "surrogatepass")

