"""Edit-aware token counts: a segment tree of pre-tokens per document.

The leaves hold blocks of pre-tokens, inner nodes the sums of characters, pre-tokens and tokens below them. An edit
finds its place by walking down character sums, re-reads only the text from the last pre-token that the edit cannot
touch to the first boundary after it that agrees with the old ones, and updates sums on the way up. Tokens of all
other pre-tokens are never looked at again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import bpe, lexicon, pretokens
from oddsloom.llm.tables import in_batches

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens of a leaf when the tree is built.
BLOCK = 64
#: Characters past its end that can decide where a pre-token ends: one, and one more behind a white run.
AHEAD = 2
#: Windows of up to so many characters, none of them from here on, are split by the pattern itself: arrays take longer to set up.
SHORT, LATIN_END = 1024, "\u0250"
PATTERN = regex.compile(public_tokenizers.PATTERN)


class TokenTree:
    """A document's pre-tokens as ``(length, tokens)`` in blocks, with sums over pairs of blocks, pairs of pairs and so on."""

    def __init__(self, text: str, lengths: np.ndarray, tokens: np.ndarray, count: Callable[[str], tuple[np.ndarray, np.ndarray]]):
        self.text, self.count, self.rescanned = text, count, 0
        cuts = range(BLOCK, len(lengths), BLOCK)
        self.blocks = [list(x) for x in zip(np.split(lengths, cuts), np.split(tokens, cuts), strict=True)]
        width = 1 << (len(self.blocks) - 1).bit_length()
        first = np.arange(0, len(lengths), BLOCK) if len(lengths) else np.zeros(0, np.int64)
        base = np.zeros((width, 2), np.int64)
        if len(first):
            base[: len(first), 0] = np.add.reduceat(lengths, first)
            base[: len(first), 1] = np.add.reduceat(tokens, first)
        self.levels = [base]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2, 2).sum(1))

    @property
    def n_tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    def _block_at(self, place: int) -> tuple[int, int]:
        """The block that holds character ``place`` (or ends there, at the text's end), and where it begins."""
        k, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            k *= 2
            if place >= begin + level[k, 0] and k + 1 < len(level) and level[k + 1, 0] + level[k + 1, 1]:
                begin, k = begin + int(level[k, 0]), k + 1
        return k, begin

    def _update(self, k: int) -> None:
        lengths, tokens = self.blocks[k]
        self.levels[0][k] = lengths.sum(), tokens.sum()
        for low, high in zip(self.levels, self.levels[1:], strict=False):
            k //= 2
            high[k] = low[2 * k] + low[2 * k + 1]

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replaces ``cut`` characters from ``at`` by ``put``."""
        at = min(max(at, 0), len(self.text))
        cut = min(max(cut, 0), len(self.text) - at)
        shift, old = len(put) - cut, self.text
        self.text = old[:at] + put + old[at + cut :]
        # The first pre-token that the edit may touch: it ends less than AHEAD before it.
        k, begin = self._block_at(max(0, at - AHEAD))
        ends = begin + np.cumsum(self.blocks[k][0])
        j = int(np.searchsorted(ends, at - AHEAD, side="right"))
        while j == len(ends) and k + 1 < len(self.blocks):
            k, begin = k + 1, int(ends[-1]) if len(ends) else begin
            ends, j = begin + np.cumsum(self.blocks[k][0]), 0
        from_ = begin + int(self.blocks[k][0][:j].sum())
        # Read on, in growing windows, until a new boundary falls on an old one at or past the edit's end.
        last, last_begin, window = k, begin, 64
        while True:
            stop = min(len(self.text), at + len(put) + window)
            lengths, tokens = self.count(self.text[from_:stop])
            self.rescanned += stop - from_
            fresh = from_ + np.cumsum(lengths)
            safe = fresh if stop == len(self.text) else fresh[fresh <= stop - AHEAD - 1]
            # old boundaries from the block where the edit ends
            last, last_begin = k, begin
            while last + 1 < len(self.blocks) and last_begin + int(self.levels[0][last, 0]) < stop - shift:
                last_begin, last = last_begin + int(self.levels[0][last, 0]), last + 1
            olds = begin + np.cumsum(np.concatenate([b[0] for b in self.blocks[k : last + 1]]))
            olds = olds[olds >= at + cut]
            meet = np.intersect1d(safe, olds + shift, assume_unique=True)
            if len(meet):
                resume = int(meet[0])
                break
            if stop == len(self.text):
                resume = stop
                break
            window *= 4
        n_new = int(np.searchsorted(fresh, resume, side="right"))
        all_len = np.concatenate([b[0] for b in self.blocks[k : last + 1]])
        all_tok = np.concatenate([b[1] for b in self.blocks[k : last + 1]])
        old_ends = begin + np.cumsum(all_len)
        tail = int(np.searchsorted(old_ends, resume - shift, side="right"))
        self.blocks[k] = [np.concatenate([all_len[:j], lengths[:n_new], all_len[tail:]]), np.concatenate([all_tok[:j], tokens[:n_new], all_tok[tail:]])]
        for b in range(k + 1, last + 1):
            self.blocks[b] = [np.empty(0, np.int64), np.empty(0, np.int64)]
        for b in range(k, last + 1):
            self._update(b)


class Counter:
    """Token counts of pre-tokens. Those of the last texts are remembered, ``HELD`` or so, as windows around edits hold them again."""

    HELD = 250_000

    def __init__(self, path: str):
        self.coder = lexicon.Coder(None, path)
        self.small: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if 0 < len(text) <= SHORT and max(text) < LATIN_END:
            words = PATTERN.findall(text)
            for w in words:
                if w not in self.small:
                    self.small[w] = len(bpe.merge(self.coder.vocabulary, w.encode()))
            return np.array([len(w) for w in words]), np.array([self.small[w] for w in words])
        lengths, tokens, _ = self.many([text])
        return lengths, tokens

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length and tokens of all pre-tokens of ``texts``, and the bounds of each text's."""
        d = pretokens.distinct(texts, "spaced")
        _, _, n = self.coder.ids_of(d.data, d.begin, d.size)
        if len(self.small) > self.HELD:
            self.small.clear()
        self.small.update(zip(d.words(), n.tolist(), strict=True))
        return d.chars[d.which], n[d.which], d.bounds


_counters: dict[str, Counter] = {}
SCHEMA = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, rescanned_chars long"


def count_edited(docs: DataFrame, edits: Column, vocabulary: str | None = None) -> DataFrame:
    """Token counts of every whole text before and after its edits, one row per row of ``docs``.

    ``edits`` is an array of ``struct(at, cut, put)`` (characters, in the text as earlier edits left it); places beyond
    the text are moved to its end. Null edits are none; null texts are empty and can be edited too. Special strings
    count as ordinary text. ``rescanned_chars`` is how much text was read again. Repeated rows are counted each;
    an empty table gives no rows; other columns are ignored.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scripts = batch.column(2).to_pylist()
            for a, b in pretokens.slices(texts):
                lengths, tokens, bounds = count.many(texts[a:b])
                rows = []
                for k in range(a, b):
                    x, y = bounds[k - a], bounds[k - a + 1]
                    tree = TokenTree(texts[k], lengths[x:y], tokens[x:y], count)
                    before = tree.n_tokens
                    for e in scripts[k] or ():
                        tree.edit(e["at"] or 0, e["cut"] or 0, e["put"] or "")
                    rows.append((before, len(scripts[k] or ()), tree.n_tokens, len(tree.text), tree.rescanned))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "rescanned_chars"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", edits.alias("edits"))
    return in_batches(rows, run, SCHEMA)
