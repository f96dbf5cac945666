"""Citation markers stripped from answers that arrive in pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "resp_id string, seq bigint, closing boolean, text string, markers array<string>"
_PIECE = Row("resp_id", "seq", "closing", "text", "markers")
_MARKER = re.compile(r"\[\[(.*?)\]\]", re.S)


def split_visible(buffer: str, final: bool) -> tuple[str, str, list[str]]:
    """(visible, held back, markers): an open ``[[`` or a trailing ``[`` waits."""
    markers = _MARKER.findall(buffer)
    rest = _MARKER.sub("", buffer)
    if final:
        return rest, "", markers
    tail_start = 0
    for found in _MARKER.finditer(buffer):
        tail_start = found.end()
    tail = buffer[tail_start:]
    open_at = tail.find("[[")
    if open_at < 0 and tail.endswith("["):
        open_at = len(tail) - 1
    if open_at < 0:
        return rest, "", markers
    held = tail[open_at:]
    return rest[: len(rest) - len(held)], held, markers


class CitationStripper(StatefulProcessor):
    """Keeps the held-back text of one response between batches, until its end or an event-time timer."""

    def __init__(self, timeout_ms: int | None) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "text string, seq bigint, at_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # The deltas of one response in one trigger, whose input the source limits.
        batch = sorted(((row.seq, row.text, row.final, row.at_ms) for row in rows), key=lambda row: row[0])
        held = self.pending.get()
        pending, last, at = held or ("", 0, 0)
        before, out = at, []
        for seq, piece, final, now in batch:
            if pending and self.timeout_ms is not None and now > at + self.timeout_ms:
                # The silence was long enough, though the watermark had not passed it yet.
                out.append(self._closed(key[0], pending, last))
                pending = ""
            visible, pending, markers = split_visible(pending + piece, bool(final))
            last, at = int(seq), int(now)
            out.append(_PIECE(key[0], seq, False, visible, markers))
        # Text is held exactly while a timer waits, so a response without any costs no further call of the state store.
        if held and self.timeout_ms is not None and not (pending and before == at):
            self.handle.deleteTimer(before + self.timeout_ms)
        if pending:
            self.pending.update((pending, last, at))
            if self.timeout_ms is not None and not (held and before == at):
                self.handle.registerTimer(at + self.timeout_ms)
        elif held:
            self.pending.clear()
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The response has ended without saying so: what was held back is visible text."""
        held = self.pending.get()
        if held:
            self.pending.clear()
            yield self._closed(key[0], held[0], held[1])

    @staticmethod
    def _closed(key: str, pending: str, last: int) -> Row:
        visible, _, markers = split_visible(pending, True)
        return _PIECE(key, last, True, visible, markers)

    def close(self) -> None:
        pass


def strip_citation_stream(deltas: DataFrame, timeout_ms: int | None = None, delay: str = "1 minute") -> DataFrame:
    """Visible text per delta of ``resp_id, seq, text, final``. Concatenating the
    rows of a response equals stripping its whole text at once.

    With ``timeout_ms`` the deltas need an event time ``ts``. A response that is silent for so long is closed:
    held-back text comes out as a ``closing`` row behind the last number and its state is gone. Without it only
    ``final`` closes.
    """
    if timeout_ms is None:
        timed, mode = deltas.withColumn("at_ms", F.lit(0).cast("bigint")), "None"
    else:
        timed = deltas.withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", delay)
        mode = "EventTime"
    return timed.groupBy("resp_id").transformWithState(CitationStripper(timeout_ms), OUTPUT, "Append", mode)
