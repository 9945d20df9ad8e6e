"""Live conversations (T5, T6): rules, tally, trend and decision of each turn from one state, in the order of turns.

Turns wait in state until the watermark has passed them, so late ones land where they belong; state of a conversation that
says nothing for long goes by an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

RULES = "array<struct<text:string,symbol:string,value:bigint>>"
OUTPUT = f"conv_id long, turn long, turns long, original_chars long, compressed_chars long, cumulative_ratio double, trend string, symbols_used long, should_continue boolean, rules {RULES}"
NEAR = 3


def four_places(x: float) -> float:
    """Four places, halves up, as Spark rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class Conversation(StatefulProcessor):
    """State of one conversation: turns that wait (by turn), the tally, and the rules that it has (by text)."""

    def __init__(self, k: int, min_len: int, idle_ms: int, step: float, min_eff: float):
        self.k, self.min_len, self.idle_ms, self.step, self.min_eff = k, min_len, idle_ms, step, min_eff

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "turn long", f"at long, original_chars long, compressed_chars long, net_efficiency double, rules {RULES}")
        self.tally = handle.getValueState("tally", "turns long, original_chars long, compressed_chars long, last array<double>, symbols long, at long")
        self.known = handle.getMapState("rules", "text string", "symbol string, first_turn long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for r in frame.itertuples():
                at = _millis(r.ts)
                some = [(x["text"], x["symbol"], int(x["value"])) for x in (() if r.rules is None else r.rules)]
                self.waiting.updateValue((int(r.turn),), (at, int(r.original_chars), int(r.compressed_chars), float(r.net_efficiency), some))
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((v[0], k[0]) for k, v in self.waiting.iterator() if v[0] <= now)
        out = [self._turn(key[0], turn) for _, turn in due]
        if not out and self.tally.exists() and self.tally.get()[5] + self.idle_ms <= now:
            self._forget()
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUTPUT.split(", ")[:10]])

    def _forget(self) -> None:
        self.tally.clear()
        self.known.clear()

    def _turn(self, conv_id: int, turn: int) -> tuple:
        at, original, compressed, net, some = self.waiting.getValue((turn,))
        self.waiting.removeKey((turn,))
        if self.tally.exists() and self.tally.get()[5] + self.idle_ms <= at:
            self._forget()
        turns, before_o, before_c, last, symbols, _ = self.tally.get() if self.tally.exists() else (0, 0, 0, [], 0, 0)
        turns, original, compressed = turns + 1, before_o + original, before_c + compressed
        last = [*last, net][-NEAR:]
        change = last[-1] - last[0]
        trend = "insufficient_data" if len(last) < NEAR else "improving" if change > self.step else "declining" if change < -self.step else "stable"
        new = []
        for text, symbol, value in sorted(some, key=lambda x: (-x[2], x[1])):  # of one text's symbols the most valuable
            if len(text) >= self.min_len and text not in {n[0] for n in new} and not self.known.containsKey((text,)):
                new.append((text, symbol, value))
        new = sorted(new, key=lambda x: (-x[2], x[0]))[: max(0, self.k - symbols)]
        for text, symbol, _ in new:
            self.known.updateValue((text,), (symbol, turn))
        symbols += len(new)
        before = last[-2] if len(last) > 1 else None
        go = turns <= 2 or not (symbols >= self.k or (net < self.min_eff and before < self.min_eff) or (trend == "declining" and net < 2 * self.min_eff) or (turns > 20 and net < 0.02))
        self.tally.update((turns, original, compressed, last, symbols, at))
        self.handle.registerTimer(at + self.idle_ms)
        ratio = four_places((original - compressed) / max(1, original))
        return conv_id, turn, turns, original, compressed, ratio, trend, symbols, go, [{"text": t, "symbol": s, "value": v} for t, s, v in new]


def conversation_state(turns: DataFrame, delay: str = "10 minutes", k: int = 262, min_len: int = 5, idle_ms: int = 3_600_000, step: float = 0.01, min_eff: float = 0.01) -> DataFrame:
    """A row per turn (OUTPUT) of a stream of turns (conv_id, turn, ts, original_chars, compressed_chars,
    net_efficiency, rules: candidates of the turn): the tally of W6, the trend of W7, the rules that W3 adds and W8's decision,
    each as in the table of all turns, however turns arrive within ``delay``.

    A turn comes out when the watermark has passed it. A conversation whose next turn is ``idle_ms`` or more later starts
    afresh. Turns later than the delay are dropped, as everywhere; a turn that comes twice counts once. The state store must be
    RocksDB's (``spark.sql.streaming.stateStore.providerClass``).
    """
    kinds = "conv_id long, turn long, ts timestamp, original_chars long, compressed_chars long, net_efficiency double"
    rows = turns.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in kinds.split(", ")], F.col("rules").cast(RULES).alias("rules"))
    return rows.withWatermark("ts", delay).groupBy("conv_id").transformWithStateInPandas(Conversation(k, min_len, idle_ms, step, min_eff), OUTPUT, "Append", "EventTime")
