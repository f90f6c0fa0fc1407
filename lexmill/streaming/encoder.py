"""Encoding of texts that arrive in pieces.

Feeds (stream, seq, text, last) of many streams are put in order, and each
stream's text is let through up to its last safe cut: a newline before a
character that isn't white space, where no grammar joins what stands on either
side. What follows is carried in state until more arrives or the stream ends.
Parts that are let through can be split and encoded on their own; the tokens
are those of the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.operators import pretok

CUT = re.compile(r"\n(?=\S)")
PARTS = "stream long, part long, text string"
STATE = "carry string, next long, part long, waiting string, ended boolean"
#: Characters that may be carried without a safe cut; beyond, the carry is let through as it is.
CARRY = 1 << 20


def advance(carry: str, feeds: list[str], ended: bool, limit: int = CARRY) -> tuple[list[str], str]:
    """The parts that can be let through, and what is carried."""
    text = carry + "".join(feeds)
    if ended:
        return [text] if text else [], ""
    cut = max((m.end() for m in CUT.finditer(text)), default=0)
    if len(text) - cut > limit:
        cut = len(text)
    return [text[:cut]] if cut else [], text[cut:]


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    carry, nxt, part, waiting, ended = state.get if state.exists else ("", 0, 0, "{}", False)
    held = {int(k): v for k, v in json.loads(waiting).items()}
    for b in batches:
        for seq, text, last in zip(b["seq"], b["text"], b["last"], strict=True):
            if int(seq) >= nxt:  # what has been let through and comes again doesn't count
                held[int(seq)] = [text or "", bool(last)]
    feeds = []
    while nxt in held and not ended:
        text, ended = held.pop(nxt)
        feeds.append(text)
        nxt += 1
    out, carry = advance(carry, feeds, ended)
    state.update((carry, nxt, part + len(out), json.dumps(held), ended))
    yield pd.DataFrame({"stream": [key[0]] * len(out), "part": range(part, part + len(out)), "text": out})


def parts(feeds: DataFrame) -> DataFrame:
    """(stream, part, text) of a streaming table of feeds. seq counts from 0; feeds that come early wait in state; finish is a feed with last."""
    return feeds.groupBy("stream").applyInPandasWithState(_step, PARTS, STATE, "append", GroupStateTimeout.NoTimeout)


def pieces(feeds: DataFrame, scheme: str = "cl100k") -> DataFrame:
    """(stream, part, pos, piece): pieces of the parts, split in the JVM."""
    return parts(feeds).select("stream", "part", F.posexplode(pretok.pieces(F.col("text"), scheme)).alias("pos", "piece"))


def throughput(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by window and type, for a stream with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
