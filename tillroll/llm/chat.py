"""Chat formatting (operator 10): a grammar and its round trip.

    conversation = { turn }
    turn         = "### " role ": " body "</turn>" line-feed
    body, role   = text in which "\\" before one of  \\ # < :  stands for that sign

A deterministic parser reads that grammar in one pass.  A text goes in as it is
if the parser gives back the same turn.  If not, its content is escaped: first
the control strings alone, then every sign that has a meaning, which always
reads back.  The finished conversation is parsed once more and compared with
its source.

The loss mask is a list of spans of the formatted text, in code points: the
bodies of the assistant's turns, each once and in order.

Defined cases: a null text or role counts as empty; turns go by number (null
first), equal ones by role and text, repeated rows are repeated turns; rows
with a null conversation form one conversation; roles can be any text; columns
other than the four play no part.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
ESCAPABLE = "\\#<:"
_MARK = re.compile(r"\\[\\#<:]|### |</turn>")
_ROLE_END = re.compile(r"\\[\\#<:]|: |### |</turn>")
_CONTROL = re.compile(r"###|</turn>|: ")
_SIGN = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\([\\#<:])")
MASKED_ROLE = "assistant"


class GrammarError(ValueError):
    """The text isn't a formatted conversation."""


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


#: From no escaping to all of it; the last always reads back.
LEVELS = (lambda t: t, lambda t: _CONTROL.sub(r"\\\g<0>", t), lambda t: _SIGN.sub(r"\\\g<0>", t))


def _until(pattern: re.Pattern, text: str, at: int, stop: str) -> int:
    """Where the first unescaped control string begins; it must be ``stop``."""
    for m in pattern.finditer(text, at):
        if m[0][0] != "\\":
            if text.startswith(stop, m.start()):
                return m.start()
            raise GrammarError(f"unexpected {m[0]!r} at {m.start()}")
    raise GrammarError(f"no {stop!r} after {at}")


def parse_spans(text: str) -> list[tuple[str, int, int]]:
    """(role, start and end of the body as written) of each turn."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise GrammarError(f"no turn at {at}")
        end_of_role = _until(_ROLE_END, text, at + len(OPEN), AFTER_ROLE)
        start = end_of_role + len(AFTER_ROLE)
        end = _until(_MARK, text, start, CLOSE)
        out.append((unescape(text[at + len(OPEN) : end_of_role]), start, end))
        at = end + len(CLOSE)
    return out


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(role, unescape(text[a:b])) for role, a, b in parse_spans(text)]


def _reads_back(text: str, turns: list[tuple[str, str]]) -> bool:
    try:
        return parse(text) == turns
    except GrammarError:
        return False


def render_turn(role: str, text: str) -> str:
    """The turn with the least escaping that the parser reads back."""
    for escape_role in LEVELS:
        head = OPEN + escape_role(role) + AFTER_ROLE
        if _reads_back(head + CLOSE, [(role, "")]):
            break
    for escape in LEVELS:
        turn = head + escape(text) + CLOSE
        if _reads_back(turn, [(role, text)]):
            return turn
    raise AssertionError("the last level always reads back")


def render(turns: list[tuple[str, str]]) -> str:
    out = "".join(render_turn(role, text) for role, text in turns)
    if not _reads_back(out, turns):
        raise AssertionError("a conversation must read back as its turns do")
    return out


def loss_spans(text: str, role: str = MASKED_ROLE) -> list[tuple[int, int]]:
    return [(a, b) for r, a, b in parse_spans(text) if r == role]


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start,end>>.

    One shuffle brings a conversation's rows together, a sort (which can spill)
    orders them, and Python reads the sorted rows as a stream, holding one
    conversation at a time.
    """
    rows = df.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def packed(done):
        texts = [render(turns) for _, turns in done]
        spans = [[{"start": a, "end": b} for a, b in loss_spans(t)] for t in texts]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "loss_spans"])

    def run(batches):
        none = object()
        now, turns, done, held = none, [], [], 0
        for part in chunks(batches):
            for conv, role, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if conv != now or now is none:
                    if now is not none:
                        done.append((now, turns))
                        if held > 4 << 20 or len(done) >= 1000:
                            yield packed(done)
                            done, held = [], 0
                    now, turns = conv, []
                turns.append((role, text))
                held += len(text)
        if now is not none:
            yield packed([*done, (now, turns)])

    return map_arrow(ordered, run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(df: DataFrame) -> DataFrame:
    """What the output of :func:`format_conversations` says, read with the parser."""

    def run(batches):
        for part in chunks(batches):
            rows = []
            for conv, text, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_arrow(df.select("conv_id", "formatted", "loss_spans"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
