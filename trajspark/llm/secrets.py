"""Secret scan: all rules in one minimised automaton, one pass over the bytes of every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.automaton import Automaton, Rule
from trajspark.llm.common import offsets_of, slices

# The rules of the contract, then well-known shapes of public services.
RULES = [
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
                   r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
                   r"""([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    Rule("service", r"(gh[opsu]_|xox[abprs]-|AIza|[rs]k_(live|test)_)[A-Za-z0-9_-]+", 24),
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
]
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def secret_spans(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id and `spans`, in code points, ordered by start, then rule.

    Null and empty texts have no spans, a null id stays null, repeated rows stay repeated, an empty table gives an
    empty one. Only the two columns are read, so others may have any name. A text may have any length: a task holds
    one slice of texts. Narrow: no shuffle, so neither sources nor copies can be hot.
    """
    rules = RULES if rules is None else rules
    kind = docs.schema[id_col].dataType.simpleString()

    auto = Automaton(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("base", pa.bool_())]))
        for batch in slices(batches, "text"):
            at, raw = offsets_of(batch.column(1))
            data, found = raw.tobytes(), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                text, here = data[a:b], []
                spans = auto.spans(text)
                if spans:  # bytes to code points
                    chars = np.concatenate([[0], np.cumsum((raw[a:b] & 0xC0) != 0x80)])
                    here = [{"kind": auto.rules[r].kind, "start": int(chars[s]), "end": int(chars[e]),
                             "base": auto.rules[r].base} for r, s, e in spans]
                found.append(here)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["id", "spans"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(scan, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col))
