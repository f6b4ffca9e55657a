"""Token counts of whole texts: batches of even bytes, encoded in Arrow functions that hand back lengths only.

The model joins pieces of its vocabulary, so nothing that it does crosses a place between two characters that follow each
other in no piece. A long text is split at such places, which changes no count: the parts are encoded apart, many to a
batch. A part is encoded as if a blank stood before it; where it begins at a blank, that is the blank itself, elsewhere
the blank is a token of its own and is taken off again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import offsets_of, slices

#: Bytes that one call of the library encodes, and characters from which a text is split. No count depends on them.
BATCH_BYTES, PART_CHARS = 1 << 20, 1 << 14
BLANK = "▁"  # how the vocabulary writes a blank


class Counter:
    """A vocabulary, and between which characters texts may be split."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)
                  if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.joined = {pair for p in pieces for pair in zip(p, p[1:])}
        # The first has to be seen to stay by itself, and a text mustn't be changed before it is cut into pieces.
        self.plain = self.model.normalize(" a  bééﬁ ") == f"{BLANK}{BLANK}a{BLANK}{BLANK}bééﬁ{BLANK}"

    def splits(self, before: str, after: str) -> bool:
        """Whether no piece holds these two characters in a row, nor, unless `after` is a blank, a blank and `after`."""
        a, b = (BLANK if c == " " else c for c in (before, after))
        return (a, b) not in self.joined and (after == " " or (BLANK, b) not in self.joined)

    def parts(self, text: str, size: int | None = None) -> Iterator[tuple[str, int]]:
        """Parts of a text, and what each counts over its share: a blank that was put before it."""
        size = size or PART_CHARS
        at, over, n = 0, 0, len(text)
        while n - at > size and self.plain:
            cut = at + size
            # A blank at the very end stays where it is: an empty part would lose it.
            while cut < n - 1 and not self.splits(text[cut - 1], text[cut]):
                cut += 1
            if cut >= n - 1:
                break
            yield text[at:cut], over
            over = text[cut] != " "
            at = cut if over else cut + 1
        yield text[at:], over

    def lengths(self, texts: list[str]) -> list[int]:
        """How many tokens each text has."""
        out = [0] * len(texts)
        batch, rows, held = [], [], 0

        def done():
            for (row, over), ids in zip(rows, self.model.encode(batch, num_threads=1)):
                out[row] += len(ids) - over
            batch.clear()
            rows.clear()

        for row, text in enumerate(texts):
            for part, over in self.parts(text):
                batch.append(part)
                rows.append((row, over))
                held += 4 * len(part)
                if held >= BATCH_BYTES:
                    done()
                    held = 0
        done()
        return out


@cache
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `path`: a vocabulary file of sentencepiece, the same on all executors. No begin, end or added special tokens; strings
    that look like special tokens are ordinary text. Null and empty texts have no bytes and no tokens. Null ids and
    repeated rows are counted like others, an empty table gives an empty one. Only the two columns are read, so others
    may have any name. Narrow: no shuffle, so neither sources nor copies can be hot; a task holds one slice of texts. A
    text with no place to split (one endless word) is encoded whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in slices(batches, "text"):
            at, _ = offsets_of(batch.column(1))
            n = count.lengths([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(at[1:] - at[:-1], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
            .withColumnRenamed("id", id_col))
