"""Chat formatting: a small sandboxed template language compiled to Python closures."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontocat.llm.common import sorted_runs

#: Strings that structure a formatted conversation. A text that holds one is escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for m in messages %}<s>[ROLE]{{ m.role | escape }}[/ROLE][INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}[/INST]</s>{% endfor %}")

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_TO_ESCAPE = re.compile(r"\\|(?:" + _CONTROL.pattern + ")")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TAGS = re.compile(r"\{%(-?)\s*(.*?)\s*(-?)%\}|\{\{(-?)\s*(.*?)\s*(-?)\}\}", re.DOTALL)
_TOKENS = re.compile(r"\s*(?:('[^']*')|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(==|!=|\+|\||\(|\)))")


def escape(text: str) -> str:
    """A backslash before every control string and backslash; ``unescape`` takes them away again."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


#: All that a template can call: one text in, one text out.
FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    """A syntax tree node: ``kind`` with operands (``parts``) and a payload (``value``)."""

    kind: str  # text, name, filter, equal, unequal, and, or, not, join, block, if, for, generation
    parts: list[Node] = field(default_factory=list)
    value: object = None


class _Expression:
    """Recursive descent over: or > and > not > (==, !=) > + > filters > atom."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 20]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def parse(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", [node, self.both()])
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", [node, self.negated()])
        return node

    def negated(self) -> Node:
        return Node("not", [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.joined()
        if sign := self.take("==", "!="):
            node = Node("equal" if sign == "==" else "unequal", [node, self.joined()])
        return node

    def joined(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = Node("join", [node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.take("|"):
            name = self.tokens[self.at] if self.at < len(self.tokens) else ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = Node("filter", [node], name)
        return node

    def atom(self) -> Node:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        token = self.tokens[self.at]
        self.at += 1
        if token[0] == "'":
            return Node("text", value=token[1:-1])
        if not re.match(r"[A-Za-z_]", token) or "__" in token:
            raise TemplateError(f"unexpected {token!r}")
        return Node("name", value=tuple(token.split(".")))


def parse(source: str) -> Node:
    """The syntax tree of a template. A minus inside a tag's brackets takes the white space on that side away."""
    stack, at, trim = [Node("block")], 0, False

    def add_text(text: str, trim_end: bool) -> None:
        text = text.lstrip() if trim else text
        text = text.rstrip() if trim_end else text
        if text:
            stack[-1].parts.append(Node("text", value=text))

    for m in _TAGS.finditer(source):
        tag, printed = m.group(2), m.group(5)
        add_text(source[at:m.start()], bool(m.group(1) or m.group(4)))
        at, trim = m.end(), bool(m.group(3) or m.group(6))
        if printed is not None:
            stack[-1].parts.append(_Expression(printed).parse())
            continue
        word, _, rest = tag.partition(" ")
        if word == "if":
            stack += [Node("if", [_Expression(rest).parse()]), Node("block")]
        elif word == "else" and len(stack) > 2 and stack[-2].kind == "if" and len(stack[-2].parts) == 1:
            stack[-2].parts.append(stack.pop())
            stack.append(Node("block"))
        elif word == "elif" and len(stack) > 2 and stack[-2].kind == "if" and len(stack[-2].parts) == 1:
            stack[-2].parts.append(stack.pop())
            stack += [Node("block"), Node("if", [_Expression(rest).parse()], "elif"), Node("block")]
        elif word == "for" and (loop := re.fullmatch(r"([A-Za-z]\w*) in (messages)", rest.strip())):
            stack += [Node("for", [], loop.groups()), Node("block")]
        elif word == "generation":
            stack += [Node("generation"), Node("block")]
        elif word in ("endif", "endfor", "endgeneration") and len(stack) > 2 and stack[-2].kind == word[3:]:
            body = stack.pop()
            stack[-1].parts.append(body)
            done = stack.pop()
            stack[-1].parts.append(done)
            while done.kind == "if" and done.value == "elif":  # ends the tests before it as well
                body, done = stack.pop(), stack.pop()
                done.parts.append(body)
                stack[-1].parts.append(done)
        else:
            raise TemplateError(f"unexpected tag {tag!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-2].kind} is not closed")
    add_text(source[at:], False)
    _known(stack[0], {})
    return stack[0]


#: What a loop binds: the fields of a message, and of the loop itself.
_FIELDS, _LOOP = ("role", "text"), ("first", "last", "index")


def _known(node: Node, names: dict[str, tuple[str, ...]]) -> None:
    """Refuses names that nothing binds, so that rendering can't meet one."""
    if node.kind == "name" and (len(node.value) != 2 or node.value[1] not in names.get(node.value[0], ())):
        raise TemplateError(f"no name {'.'.join(node.value)!r}")
    if node.kind == "for":
        names = {**names, node.value[0]: _FIELDS, "loop": _LOOP}
    for part in node.parts:
        _known(part, names)


def fold(node: Node) -> Node:
    """Evaluates what does not depend on a conversation and joins neighbouring constant texts."""
    node = Node(node.kind, [fold(p) for p in node.parts], node.value)
    constant = bool(node.parts) and all(p.kind == "text" for p in node.parts)
    if node.kind in ("equal", "unequal", "join", "filter", "and", "or", "not") and constant:
        value = _EXPRESSIONS[node.kind](node, [lambda _, v=p.value: v for p in node.parts])({})
        return Node("text", value=value)
    if node.kind == "if" and node.parts[0].kind == "text":
        chosen = node.parts[1:] if node.parts[0].value else node.parts[2:]
        return chosen[0] if chosen else Node("block")
    if node.kind == "block":
        flat: list[Node] = []
        for p in node.parts:
            for x in p.parts if p.kind == "block" else [p]:
                if x.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", value=f"{flat[-1].value}{x.value}")
                elif x.kind != "text" or x.value != "":
                    flat.append(x)
        node.parts = flat
    return node


def _name(node: Node, _parts: list) -> Callable:
    head, *rest = node.value

    def get(scope: dict):
        value = scope[head]
        for key in rest:
            value = value[key]  # items of plain dicts only, never attributes
        return value
    return get


#: Closures of expressions: from a node and its operands' closures.
_EXPRESSIONS: dict[str, Callable] = {
    "text": lambda node, _: lambda scope, v=node.value: v,
    "name": _name,
    "filter": lambda node, p: lambda scope, f=FILTERS[node.value]: f(p[0](scope)),
    "join": lambda node, p: lambda scope: p[0](scope) + p[1](scope),
    "equal": lambda node, p: lambda scope: p[0](scope) == p[1](scope),
    "unequal": lambda node, p: lambda scope: p[0](scope) != p[1](scope),
    "and": lambda node, p: lambda scope: p[0](scope) and p[1](scope),
    "or": lambda node, p: lambda scope: p[0](scope) or p[1](scope),
    "not": lambda node, p: lambda scope: not p[0](scope),
}


class _Output:
    """Rendered pieces and the generation spans, in code points."""

    def __init__(self):
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _statement(node: Node) -> Callable[[dict, _Output], None]:
    if node.kind == "block":
        parts = [_statement(p) for p in node.parts]

        def block(scope, out):
            for part in parts:
                part(scope, out)
        return block
    if node.kind == "if":
        test, yes = _expression(node.parts[0]), _statement(node.parts[1])
        no = _statement(node.parts[2]) if len(node.parts) > 2 else None

        def choose(scope, out):
            if test(scope):
                yes(scope, out)
            elif no:
                no(scope, out)
        return choose
    if node.kind == "for":
        name, source = node.value
        body = _statement(node.parts[0])

        def loop(scope, out):
            items = scope[source]
            for i, item in enumerate(items):
                body({**scope, name: item, "loop": {"first": i == 0, "last": i == len(items) - 1, "index": str(i + 1)}}, out)
        return loop
    if node.kind == "generation":
        body = _statement(node.parts[0])

        def generation(scope, out):
            start = out.length
            body(scope, out)
            out.spans.append((start, out.length))
        return generation
    value = _expression(node)
    return lambda scope, out: out.add(value(scope))


def _expression(node: Node) -> Callable[[dict], object]:
    if node.kind not in _EXPRESSIONS:
        raise TemplateError(f"{node.kind} is no expression")
    return _EXPRESSIONS[node.kind](node, [_expression(p) for p in node.parts])


def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (``role``, ``text``) to the formatted text and its generation spans."""
    run = _statement(fold(parse(source)))

    def render(messages) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        run({"messages": messages}, out)
        return "".join(out.pieces), out.spans
    return render


FORMATTED = "conv_id bigint, text string, spans array<struct<start:bigint,stop:bigint>>"


def format_conversations(turns: DataFrame, *, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation of ``turns (conv_id, turn, role, text)``: formatted text and loss spans.

    Rows are ordered by turn (nulls first), then role and text, so equal turns
    have a fixed order; repeated rows are repeated turns. Null texts and roles
    are empty; a null conv_id is a conversation of its own. Rows are dealt by
    conv_id, sorted by Spark, and rendered run by run as they stream past: a
    task holds one batch and one conversation, which is one training text and
    thus one value whatever its length. Without rows there is no conversation.
    Extra columns are not read.
    """
    compile_template(template)  # errors of the template come up here, not in tasks

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        for table in sorted_runs(batches, ["conv_id"]):
            columns = [table[c].to_pylist() for c in ("conv_id", "role", "text")]
            ids, texts, spans = [], [], []
            for conv, rows in groupby(zip(*columns), key=itemgetter(0)):
                text, loss = run([{"role": role, "text": said} for _, role, said in rows])
                ids.append(conv)
                texts.append(text)
                spans.append([{"start": x, "stop": y} for x, y in loss])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                ["conv_id", "text", "spans"])

    rows = turns.select(F.col("conv_id").cast("bigint"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(render, FORMATTED))


def read_back(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns ``(role, text)`` and the texts under the loss spans, from a conversation formatted by ``TEMPLATE``."""
    turns, fields, opened, at = [], {}, None, 0
    for m in re.finditer(r"\\(?:.)|" + _CONTROL.pattern, text, re.DOTALL):
        mark = m.group()
        if mark[0] == "\\":
            continue
        if mark in ("[ROLE]", "[INST]"):
            opened, at = mark, m.end()
        elif mark in ("[/ROLE]", "[/INST]") and opened == mark.replace("/", ""):
            fields[opened], opened = unescape(text[at:m.start()]), None
        elif mark == "</s>":
            turns.append((fields.get("[ROLE]", ""), fields.get("[INST]", "")))
            fields = {}
    return turns, [unescape(text[a:b]) for a, b in spans]


def read_back_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`read_back` finds in formatted conversations: turns, all they say, and the text under the loss spans."""
    for batch in batches:
        n, said, loss = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns, learned = read_back(text, [(s["start"], s["stop"]) for s in spans])
            n.append(len(turns))
            said.append("".join(f"{role}\n{words}\n" for role, words in turns))
            loss.append("".join(learned))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(loss, pa.string()),
             pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64())],
            ["conv_id", "n_turns", "said", "loss", "formatted_chars"])
