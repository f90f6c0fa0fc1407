"""Writers of vocabularies, packed ids and reports."""

from __future__ import annotations

import base64
import html
import json
import struct

from pyspark.sql import DataFrame

from lexmill.operators.models import Vocab

from .readers import CAPCODES, MAGIC, NORMALIZERS


def ranks_text(v: Vocab) -> bytes:
    order = sorted(v.ranks.items(), key=lambda x: x[1])
    return b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in order)


def tokenizer_json(v: Vocab, kind: str = "BPE", merges: list[tuple[str, str]] = ()) -> bytes:
    from lexmill.functions.text import byte_alphabet

    table = byte_alphabet()
    name = lambda t: "".join(table[b] for b in t)
    if kind == "Unigram":
        model = {"type": kind, "unk_id": v.unk, "vocab": [[(t or b"").decode("utf-8", "replace"), s] for t, s in zip(v.tokens, v.scores, strict=True)], "byte_fallback": v.byte_fallback}
    elif kind == "WordPiece":
        model = {"type": kind, "unk_token": (v.tokens[v.unk] or b"").decode(), "continuing_subword_prefix": v.prefix.decode(), "max_input_chars_per_word": v.max_word, "vocab": {t.decode("utf-8", "replace"): i for i, t in enumerate(v.tokens) if t}}
    else:
        model = {"type": "BPE", "vocab": {name(t): i for i, t in enumerate(v.tokens) if t}, "merges": [f"{a} {b}" for a, b in merges or [(name(a), name(b)) for a, b in rank_merges(v)]]}
    level = {"type": "ByteLevel"} if kind == "BPE" else None
    return json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}, ensure_ascii=False).encode()


def rank_merges(v: Vocab) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token of two or more bytes, in order of rank: what its bytes become with lower ranks alone."""
    from lexmill.operators.models import merge_parts

    out = []
    for t, r in sorted(v.ranks.items(), key=lambda x: x[1]):
        if len(t) > 1:
            parts = merge_parts([t[i : i + 1] for i in range(len(t))], {k: x for k, x in v.ranks.items() if x < r and len(k) < len(t) and k in t})
            if len(parts) == 2:
                out.append((parts[0], parts[1]))
    return out


def piece_model(v: Vocab, types: list[int] | None = None, kind: int = 1) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(n: int, x: bytes) -> bytes:
        return varint(n << 3 | 2) + varint(len(x)) + x

    scores = v.scores or [-float(i) for i in range(len(v.tokens))]
    body = b"".join(field(1, field(1, t or b"") + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for t, s, k in zip(v.tokens, scores, types or [1] * len(v.tokens), strict=True))
    return body + field(2, varint(3 << 3) + varint(kind))


def binary(v: Vocab, version: int = 3, capcode: str = "none", normalizer: list[str] = (), aliases: list[tuple[int, bytes]] = (), twins: list[tuple[int, bytes, list[tuple[int, int]]]] = ()) -> bytes:
    """A header, the bytes of all tokens, where each ends, the words in each; then aliases from version 2 and twins with their alternatives from version 3."""
    from lexmill.operators.models import traits

    tokens = [t or b"" for t in v.tokens]
    number = lambda n, size=4: n.to_bytes(size, "little")
    ends = [0]
    for t in tokens:
        ends.append(ends[-1] + len(t))
    norm = sum(bit for bit, n in NORMALIZERS.items() if n in normalizer)
    head = MAGIC + bytes([version, version, CAPCODES.index(capcode), min(255, max(map(len, tokens), default=0)), norm])
    out = [head, number(len(tokens)), number(v.unk), number(ends[-1]), *tokens, *map(number, ends), bytes(min(255, traits(t).words) for t in tokens)]
    if version >= 2:
        out += [number(len(aliases)), *(number(i) + number(len(x)) + x for i, x in aliases)]
    if version >= 3:
        out += [number(len(twins)), *(number(i) + number(len(k)) + k + number(len(a), 1) + b"".join(number(x) + number(n) for x, n in a) for i, k, a in twins)]
    return b"".join(out)


def world_text(v: Vocab) -> bytes:
    """Lines of id, Python literal and byte length."""
    return b"".join(b"%d %s %d\n" % (i, repr(t).encode(), len(t)) for i, t in enumerate(v.tokens) if t is not None)


def tekken_json(v: Vocab, special: int = 0, pattern: str = "") -> bytes:
    """Ranked byte tokens after special tokens, whose names aren't kept."""
    tokens = [t for t in v.tokens[special:] if t is not None]
    rows = [{"rank": r, "token_bytes": base64.b64encode(t).decode(), "token_str": None} for r, t in enumerate(tokens)]
    return json.dumps({"config": {"pattern": pattern, "default_vocab_size": len(tokens) + special, "default_num_special_tokens": special}, "vocab": rows}).encode()


def write_shards(packed: DataFrame, path: str, by: list[str]) -> None:
    """Packed sequences as Parquet, a folder for each value of by: the canonical form at any size."""
    packed.write.mode("overwrite").partitionBy(*by).parquet(path) if by else packed.write.mode("overwrite").parquet(path)


def merge_map(rows: DataFrame, path: str) -> None:
    rows.select("b_id", "merged_id").write.mode("overwrite").json(path)


def report_json(summary: dict, **tables: list[dict]) -> str:
    return json.dumps({**summary, **tables}, ensure_ascii=False, indent=1, default=str)


def report_markdown(title: str, rows: list[dict]) -> str:
    if not rows:
        return f"# {title}\n"
    names = list(rows[0])
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows)]) + "\n"


def report_html(title: str, tables: dict[str, list[dict]]) -> str:
    body = "".join(f"<h2>{html.escape(k)}</h2><table>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r.values()) + "</tr>" for r in rows) + "</table>" for k, rows in tables.items())
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}"
