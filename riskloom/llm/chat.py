"""Chat formatting of turns made of typed content parts.

A turn's content is an ordered array of parts: struct<kind, text, ref, width, height, seconds, pages>. A visitor turns
each part into a string by its kind: text is escaped, an image, audio clip or document becomes a placeholder that is
numbered in order within the turn, with its reference and the number of tokens it expands to beside it. The rendered
turn is one row, so nothing is shuffled and a conversation of any length never meets in one row; its formatted text is
the concatenation of its rows by position.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` gets one in
between (``<\\|``), so no control string of a text survives and taking one backslash off each escape restores it.

Defined cases: a null role or text is empty; a turn without parts is empty; a part of another kind, or a null part, is
rendered as nothing; missing sizes count as 0, and every attachment takes one token at least; turns of equal number
are ordered by role, then text; rows with a null conv_id are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PLACED = "struct<shown:string,attachment:struct<kind:string,ref:string,n_tokens:bigint>>"
TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)<\|im_end\|>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column, line_ends: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if line_ends else out


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class PartVisitor:
    """What each kind of part becomes: its string and, for attachments, how many tokens it expands to."""

    patch: int = 14              # pixels a side that one image token covers
    audio_rate: float = 25.0     # tokens a second
    page_tokens: int = 512       # tokens a document page

    def text(self, part: Column) -> Column:
        return self._shown(escape(part["text"]))

    def image(self, part: Column) -> Column:
        side = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / F.lit(self.patch))
        return self._attached(part, side(part["width"]) * side(part["height"]))

    def audio(self, part: Column) -> Column:
        return self._attached(part, F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(self.audio_rate)))

    def document(self, part: Column) -> Column:
        return self._attached(part, F.coalesce(part["pages"], F.lit(0)) * F.lit(self.page_tokens))

    def _shown(self, shown: Column) -> Column:
        return F.struct(shown.alias("shown"), F.lit(None).cast("struct<kind:string,ref:string,n_tokens:bigint>").alias("attachment")).cast(PLACED)

    def _attached(self, part: Column, n_tokens: Column) -> Column:
        kept = F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), F.greatest(n_tokens.cast("bigint"), F.lit(1)).alias("n_tokens"))
        return F.struct(F.lit("").alias("shown"), kept.alias("attachment")).cast(PLACED)

    def visit(self, part: Column) -> Column:
        by_kind = F.when(part["kind"] == "text", self.text(part))
        for kind in ("image", "audio", "document"):
            by_kind = by_kind.when(part["kind"] == kind, getattr(self, kind)(part))
        return by_kind.otherwise(self._shown(F.lit("")))

    def flatten(self, parts: Column) -> Column:
        """struct(body, attachments): the parts in order, placeholders numbered from 0 by their place among attachments."""
        placed = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), self.visit)
        start = F.struct(F.lit("").alias("body"), F.array().cast("array<struct<kind:string,ref:string,n_tokens:bigint>>").alias("attachments"))

        def step(done, part):
            slot = F.concat(F.lit("<|"), part["attachment"]["kind"], F.lit(":"), F.size(done["attachments"]).cast("string"), F.lit("|>"))
            held = part["attachment"].isNotNull()
            return F.struct(F.concat(done["body"], F.when(held, slot).otherwise(part["shown"])).alias("body"),
                            F.when(held, F.concat(done["attachments"], F.array(part["attachment"]))).otherwise(done["attachments"]).alias("attachments"))

        return F.aggregate(placed, start, step)


def text_part(text: Column) -> Column:
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])


def format_turns(turns: DataFrame, visitor: PartVisitor = PartVisitor()) -> DataFrame:
    """conv_id, turn, role, parts -> conv_id, turn, formatted, loss_start, loss_end, attachments, n_tokens_attached.

    The loss span (assistant turns only; code points in ``formatted``) is the escaped text without marks.
    """
    flat = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), visitor.flatten(F.col("parts")).alias("flat"))
    head = F.concat(F.lit(START), escape(F.col("role"), line_ends=True), F.lit("\n"))
    trained = F.col("role") == ASSISTANT
    return flat.select(
        "conv_id", "turn", F.concat(head, F.col("flat.body"), F.lit(END + "\n")).alias("formatted"),
        F.when(trained, F.length(head)).cast("bigint").alias("loss_start"),
        F.when(trained, F.length(head) + F.length("flat.body")).cast("bigint").alias("loss_end"),
        F.col("flat.attachments").alias("attachments"),
        F.aggregate(F.col("flat.attachments"), F.lit(0).cast("bigint"), lambda n, a: n + a["n_tokens"]).alias("n_tokens_attached"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted turns and digest each conversation in order: turns, loss text, length.

    Rows are sorted by conversation and turn inside partitions and streamed through running digests, so a conversation
    of any length takes constant memory.
    """

    def run(batches: Iterator):
        import pyarrow as pa

        now, rows = None, []

        def close():
            conv, n, digest, loss_chars, loss, chars = now
            rows.append((conv, n, digest.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            for conv, shown, lo, hi in zip(*[b.column(k).to_pylist() for k in (0, 2, 3, 4)], strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                m = TURN.fullmatch(shown)
                role, text = unescape(m[1]), unescape(m[2])
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    said = unescape(shown[lo:hi])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(shown)
            if len(rows) >= 4096:
                yield flush()
        if now is not None:
            close()
        if rows:
            yield flush()

    order = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return order.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
