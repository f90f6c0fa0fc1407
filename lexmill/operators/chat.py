"""Chat transcripts: rendering by a template, and reading rendered text back."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHATML = "{% for m in messages %}<|im_start|>{{ m.role }}\n{{ m.content }}<|im_end|>\n{% endfor %}{% if add_generation_prompt %}<|im_start|>assistant\n{% endif %}"


def messages(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    return turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def render_chatml(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    one = F.transform("messages", lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n")))
    return messages(turns, conv).select(conv, F.array_join(one, "").alias("prompt"))


def invert_chatml(prompts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text) of rendered prompts, in the JVM."""
    parts = F.regexp_extract_all("prompt", F.lit(r"(?s)<\|im_start\|>.*?<\|im_end\|>"), F.lit(0))
    rows = prompts.select(conv, F.posexplode(parts).alias("turn", "p"))
    return rows.select(conv, "turn", F.regexp_extract("p", r"<\|im_start\|>([^\n]*)\n", 1).alias("role"), F.regexp_extract("p", r"(?s)<\|im_start\|>[^\n]*\n(.*)<\|im_end\|>", 1).alias("text"))


STYLES = {
    "chatml": re.compile(r"<\|im_start\|>(?P<role>[^\n]*)\n(?P<text>.*?)(?P<end><\|im_end\|>\n?|$)", re.S),
    "gemma": re.compile(r"<start_of_turn>(?P<role>[^\n]*)\n(?P<text>.*?)(?P<end><end_of_turn>\n?|$)", re.S),
    "bracket": re.compile(r"\[INST\] ?(?P<user>.*?) ?\[/INST\](?: ?(?P<assistant>.*?)(?P<end></s>|$))?", re.S),
}


def invert(prompt: str, style: str) -> list[dict]:
    """Messages of a prompt; partial says that the last one isn't ended. In the bracket style a system text stands in <<SYS>> marks of the first user text."""
    out = []
    for m in STYLES[style].finditer(prompt):
        if style != "bracket":
            role = "assistant" if m["role"] == "model" else m["role"]
            out.append({"role": role, "content": m["text"], "partial": not m["end"]})
            continue
        user = m["user"]
        system = re.match(r"<<SYS>>\n(.*?)\n<</SYS>>\n\n", user, re.S)
        if system:
            out.append({"role": "system", "content": system[1], "partial": False})
            user = user[system.end() :]
        out.append({"role": "user", "content": user, "partial": False})
        if m["assistant"]:
            out.append({"role": "assistant", "content": m["assistant"], "partial": not m["end"]})
    return out


# --- a small template language -------------------------------------------------

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[-+<>()\[\].,|:~])|(\w+))")


class _Expression:
    def __init__(self, text: str, scope: dict):
        self.tokens = [m.group(0).strip() for m in _TOKEN.finditer(text) if m.group(0).strip()]
        self.at, self.scope = 0, scope

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *want: str) -> bool:
        if self.peek() in want:
            self.at += 1
            return True
        return False

    def value(self):
        x = self.either()
        if self.take("if"):
            ok = self.either()
            other = self.value() if self.take("else") else ""
            return x if ok else other
        return x

    def either(self):
        x = self.both()
        while self.take("or"):
            y = self.both()
            x = x or y
        return x

    def both(self):
        x = self.inverse()
        while self.take("and"):
            y = self.inverse()
            x = x and y
        return x

    def inverse(self):
        return not self.inverse() if self.take("not") else self.compared()

    def compared(self):
        x = self.sum()
        while (op := self.peek()) in ("==", "!=", "<", ">", "<=", ">=", "in", "not", "is"):
            self.at += 1
            if op == "is":
                negated = self.take("not")
                name = self.tokens[self.at]
                self.at += 1
                x = {"defined": x is not None, "none": x is None, "string": isinstance(x, str)}[name] != negated
                continue
            if op == "not":
                self.take("in")
            y = self.sum()
            x = {"==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y, "in": lambda: x in y, "not": lambda: x not in y}[op]()
        return x

    def sum(self):
        x = self.filtered()
        while (op := self.peek()) in ("+", "-", "~"):
            self.at += 1
            y = self.filtered()
            x = x - y if op == "-" else f"{x}{y}" if op == "~" else x + y
        return x

    def filtered(self):
        x = self.primary()
        while self.take("|"):
            name = self.tokens[self.at]
            self.at += 1
            x = {"trim": lambda: x.strip(), "length": lambda: len(x), "upper": lambda: x.upper(), "lower": lambda: x.lower()}[name]()
        return x

    def primary(self):
        t = self.peek()
        self.at += 1
        if t == "(":
            x = self.value()
            self.take(")")
        elif t == "[":
            x = []
            while not self.take("]"):
                x.append(self.value())
                self.take(",")
        elif t.isdigit():
            x = int(t)
        elif t[:1] in "'\"":
            x = t[1:-1].replace("\\n", "\n").replace("\\'", "'").replace('\\"', '"')
        else:
            x = {"true": True, "false": False, "none": None}.get(t.lower(), self.scope.get(t))
        while self.peek() in (".", "["):
            if self.take("["):
                key = self.value()
                self.take("]")
            else:
                self.at += 1
                key = self.tokens[self.at]
                self.at += 1
                if self.take("("):
                    args = []
                    while not self.take(")"):
                        args.append(self.value())
                        self.take(",")
                    x = getattr(x, {"strip": "strip", "lstrip": "lstrip", "rstrip": "rstrip", "upper": "upper", "lower": "lower", "startswith": "startswith", "endswith": "endswith", "split": "split", "replace": "replace"}[key])(*args)
                    continue
            x = x.get(key) if isinstance(x, dict) else x[key] if isinstance(x, list | str) and isinstance(key, int) else None
        return x


def _tree(parts: list[str], at: int = 0, stop: tuple[str, ...] = ()) -> tuple[list, int]:
    out = []
    while at < len(parts):
        p = parts[at]
        at += 1
        if p.startswith("{{"):
            out.append(("value", p.strip("{}-").strip()))
        elif p.startswith("{%"):
            code = p[2:-2].strip("-").strip()
            word = code.split(None, 1)[0]
            if word in stop:
                return out, at - 1
            if word == "for":
                name, _, what = code[4:].partition(" in ")
                body, at = _tree(parts, at, ("endfor",))
                at += 1
                out.append(("for", name.strip(), what, body))
            elif word == "if":
                arms = [(code[3:], None)]
                done = []
                while True:
                    body, at = _tree(parts, at, ("elif", "else", "endif"))
                    done.append((arms[-1][0], body))
                    nxt = parts[at][2:-2].strip("-").strip()
                    at += 1
                    if nxt == "endif":
                        break
                    arms.append(("true" if nxt == "else" else nxt[5:], None))
                out.append(("if", done))
            elif word == "set":
                name, _, what = code[4:].partition("=")
                out.append(("set", name.strip(), what))
        elif p:
            out.append(("text", p))
    return out, at


def _render(tree: list, scope: dict, out: list[str]) -> None:
    for node in tree:
        if node[0] == "text":
            out.append(node[1])
        elif node[0] == "value":
            x = _Expression(node[1], scope).value()
            out.append("" if x is None else str(x))
        elif node[0] == "set":
            scope[node[1]] = _Expression(node[2], scope).value()
        elif node[0] == "if":
            for test, body in node[1]:
                if _Expression(test, scope).value():
                    _render(body, scope, out)
                    break
        else:
            items = _Expression(node[2], scope).value() or []
            for i, x in enumerate(items):
                scope |= {node[1]: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1}}
                _render(node[3], scope, out)


def render(template: str, **scope) -> str:
    """A template of the chat kind: values with filters and methods, if/elif/else, for and set. A - in a tag takes the white space beside it away."""
    parts = _TAG.split(template)
    for i in range(1, len(parts), 2):
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-" and i + 1 < len(parts):
            parts[i + 1] = parts[i + 1].lstrip()
    tree, _ = _tree(parts)
    out: list[str] = []
    _render(tree, dict(scope), out)
    return "".join(out)


def render_template(turns: DataFrame, template: str, conv: str = "conv_id", **scope) -> DataFrame:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ms: render(template, messages=[{"role": m["role"], "content": m["text"]} for m in ms], **scope))

    return messages(turns, conv).select(conv, run("messages").alias("prompt"))
