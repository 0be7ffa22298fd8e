"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as exactly one token is proved once,
against the library itself.  A pre-token that is such a string counts as one;
only the others are merged, once per distinct string and cache.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: White space as the byte-level pre-tokenizer sees it, and its split pattern (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Distinct merged pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 800_000
#: Marks that may close a word (fixed values): together one pre-token.
MARKS = ".,;:!?"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it prints, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {}, 256
    for b in range(256):
        out[b] = chr(b if b in shown else free)
        free += b not in shown
    return out


def prove_whole_tokens(tokenizer) -> dict[str, int]:
    """Strings of the vocabulary that the library encodes alone as their own single token."""
    back = {c: b for b, c in byte_alphabet().items()}
    strings = []
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            strings.append((bytes(back[c] for c in token).decode(), i))
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: no pre-token is like that
    coded = tokenizer.encode_batch([s for s, _ in strings], add_special_tokens=False)
    return {s: 1 for (s, i), e in zip(strings, coded, strict=True) if e.ids == [i]}


def merger(path: str):
    """A function from one pre-token to its number of tokens, by merging its bytes.

    Where the file's ids follow the order of its merges (checked here), the merge
    runs in a rank encoder made of the same vocabulary; else in the library's model.
    """
    import tiktoken
    from tokenizers import Tokenizer

    model = json.loads(Path(path).read_text())["model"]
    back = {c: b for b, c in byte_alphabet().items()}
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    first = len(back)
    if all(c in vocab for c in back) and max(vocab[c] for c in back) < first and all(vocab.get(a + b) == first + i for i, (a, b) in enumerate(merges)):
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if i < first + len(merges)}
        encode = tiktoken.Encoding("rest", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda piece: len(encode(piece))
    tokenize, alphabet = Tokenizer.from_file(path).model.tokenize, byte_alphabet()
    return lambda piece: len(tokenize(piece.encode().decode("latin-1").translate(alphabet)))


class Counts(dict):
    """Tokens of each word with the blank before it.

    A word that is a proved whole token counts one at once.  Any other is cut
    into pre-tokens; proved ones count one each, the rest is merged.
    """

    def __init__(self, whole: dict[str, int], merge) -> None:
        import regex

        super().__init__(whole)
        self.whole, self.merge, self.find = whole, merge, regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) < 200:
            if len(self) > len(self.whole) + REMEMBERED:
                self.clear()
                self.update(self.whole)
            self[word] = n
        return n

    def count(self, text: str) -> int:
        whole, merge = self.whole, self.merge
        word = text.rstrip(MARKS)
        if (word[1:] if word[:1] == " " else word).isalpha():  # the usual case: letters, then marks
            n = 1 if word in whole else merge(word)
            if len(word) < len(text):
                marks = text[len(word) :]
                n += 1 if marks in whole else merge(marks)
            return n
        return sum(1 if p in whole else merge(p) for p in self.find(text))


@lru_cache(maxsize=1)
def counter(path: str):
    """A function from text to its number of tokens, as the library gives it by default.

    A blank between two other characters that are not white space always starts a
    pre-token, so there a text is cut into words; texts where blanks meet other
    white space are cut by the full pattern.  A worker keeps the function, and so
    what it has learned, from one task to the next.
    """
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    counts = Counts(prove_whole_tokens(tokenizer), merger(path))
    get = counts.__getitem__
    before, after = re.compile(f"[{SPACE}] ").search, re.compile(f" [{SPACE}]").search
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def plain(text: str) -> int:
        if not text or before(text) or after(text):
            return counts.count(text)
        head, *tail = text.replace(" ", "\0 ").split("\0") if "\0" not in text else (text, None)
        if tail == [None]:
            return counts.count(text)
        return (get(head) if head else 0) + sum(map(get, tail))

    def count(text: str) -> int:
        if cut and any(s in text for s in special):
            parts = cut.split(text)
            return len(parts) - 1 + sum(map(plain, parts))
        return plain(text)

    return count


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens.

    ``vocabulary`` is the path of a byte-level BPE file that every executor has.
    Null and empty texts count 0; ids may be null or repeat; other columns are
    ignored.  Each worker proves the shortcut once (a second).  One narrow pass, no
    shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in slices(batches):
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(b.column(1)), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(map(count, texts(b)), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
