"""Token counts with a whole-token shortcut.

A vocabulary string that the tokenizer encodes alone as one token costs one token wherever it
stands as a pre-token, because byte-level BPE merges never cross pre-tokens. Those strings are
proved one by one before the job starts. Only the other pre-tokens are merged, each distinct
one once for a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import shielded, travels

#: Pre-token pattern of the byte-level vocabularies (a fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern with its classes spelt out for texts below U+0100, which the faster standard
#: matcher can read (fixed values of Unicode).
LETTERS, NUMBERS, BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\r\x0b\x0c\x85\xa0"
LATIN_PRE_TOKEN = rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
#: A task forgets what it has merged beyond so many distinct pre-tokens.
REMEMBER = 400_000
#: Pre-tokens that are held at a time.
PIECES = 200_000

travels(__name__)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, back to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(spec: str) -> list[str]:
    """Vocabulary strings that are one pre-token and encode alone as exactly their own token.

    spec is the text of a tokenizer file. Strings that are no valid UTF-8 can't be a pre-token
    and are left out, special tokens too."""
    import regex
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    letters, pattern = _byte_letters(), regex.compile(PRE_TOKEN)
    specials = {t["content"] for t in json.loads(spec).get("added_tokens") or []}
    names, ids = [], []
    for s, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(letters[c] for c in s).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if text not in specials and pattern.fullmatch(text) and pattern.match(text).end() == len(text):
            names.append(text)
            ids.append(i)
    alone = tok.encode_batch(names, add_special_tokens=False)
    return sorted(s for s, i, e in zip(names, ids, alone, strict=True) if e.ids == [i])


def _checked(spec: str) -> list[str]:
    """The special strings of a tokenizer file, after checking that this method fits it."""
    d = json.loads(spec)
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    if d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("dropout"):
        raise ValueError("the whole-token shortcut is proved for plain byte-level BPE only")
    added = d.get("added_tokens") or []
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        raise ValueError("special tokens that take white space along are not supported")
    return sorted((t["content"] for t in added), key=lambda s: (-len(s), s))


def _counter(spec: str, whole: list[str], specials: list[str]):
    """A function from texts to their numbers of tokens."""
    import re

    import regex
    from tokenizers import Tokenizer

    merge = Tokenizer.from_str(spec).model.tokenize
    letters = {b: c for c, b in _byte_letters().items()}
    wide, latin = regex.compile(PRE_TOKEN), re.compile(LATIN_PRE_TOKEN)
    split = regex.compile("|".join(map(regex.escape, specials))) if specials else None
    cost = dict.fromkeys(whole, 1)

    def pieces_of(text: str) -> Iterator[list[str]]:
        try:
            text.encode("latin-1")
            pattern = latin
        except UnicodeEncodeError:
            pattern = wide
        if len(text) <= PIECES:
            yield pattern.findall(text)
            return
        held = []
        for m in pattern.finditer(text):
            held.append(m[0])
            if len(held) == PIECES:
                yield held
                held = []
        yield held

    def counts(texts: list[str | None]) -> list[int]:
        nonlocal cost
        totals, waiting, n, missing = [0] * len(texts), [], 0, set()

        def settle() -> None:
            nonlocal cost, n
            if missing:
                cost.update((p, len(merge(p.encode().decode("latin-1").translate(letters)))) for p in missing)
            for k, pieces in waiting:
                totals[k] += sum(map(cost.__getitem__, pieces))
            waiting.clear()
            missing.clear()
            n = 0
            if len(cost) > len(whole) + REMEMBER:
                cost = dict.fromkeys(whole, 1)

        for k, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if split is not None and any(s in text for s in specials):
                parts = split.split(text)
                totals[k] += len(parts) - 1
            for part in filter(None, parts):
                for pieces in pieces_of(part):
                    waiting.append((k, pieces))
                    missing.update(set(pieces).difference(cost))
                    n += len(pieces)
                    if n >= PIECES:
                        settle()
        settle()
        return totals

    return counts


@shielded(["text"], ["out"])
def count_tokens(docs: DataFrame, tokenizer_file: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a long column `out`: the tokens of each whole text.

    As the library counts them without begin, end or added special tokens; a special string
    inside a text is the one token that it is by default. Null and empty texts have 0 tokens.
    Texts of any length are read in bounded slices; repeated rows are counted each; an empty
    table gives an empty one. The tokenizer file is read on the driver and broadcast with the
    proved strings; both are bounded by the vocabulary.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    specials = _checked(spec)
    sent = docs.sparkSession.sparkContext.broadcast((spec, prove_whole_tokens(spec), specials))

    @F.arrow_udf(T.LongType())
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = _counter(*sent.value)
        for batch in batches:
            yield pa.array(counts(batch.to_pylist()), pa.int64())

    return docs.withColumn(out, tokens(F.col(text).cast("string")))
