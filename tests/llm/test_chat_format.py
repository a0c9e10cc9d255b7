import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from ontocat.llm import chat_format as C

TURNS = "conv_id bigint, turn bigint, role string, text string, spans string"
PIECES = st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "[", "s>", "/", "INST]", "a", "\n", "\u00e9", "\U0001f600", " ok "]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]) | PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    text, spans = C.compile_template(C.TEMPLATE)([{"role": r, "text": t} for r, t in turns])
    back, loss = C.read_back(text, spans)
    assert back == turns
    assert loss == [t for r, t in turns if r == "assistant"]


def test_language():
    def run(source, *messages):
        return C.compile_template(source)([dict(zip(("role", "text"), m)) for m in messages])

    assert run("a{{ 'b' + 'c' | upper }}{% if 'x' == 'y' or not ('a' != 'a') %}d{% else %}e{% endif %}")[0] == "abCd"
    assert run("{% for m in messages %}{% if m.role == 'user' and m.text != '' %}{{ m.text | trim }};{% endif %}{% endfor %}",
               ("user", " x "), ("user", ""), ("bot", "z"))[0] == "x;"
    assert run("ab{% generation %}{% for m in messages %}{{ m.text }}{% endfor %}{% endgeneration %}c", ("u", "xyz")) == ("abxyzc", [(2, 5)])
    assert C.fold(C.parse("a{% if 'x' == 'x' %}b{{ 'c' | upper }}{% endif %}d")).parts == [C.Node("text", value="abCd")]
    choice = "{% for m in messages %}{% if m.role == 'a' %}A{% elif m.role == 'b' %}B{% elif m.role == 'c' %}C{% else %}-{% endif %}{% endfor %}"
    assert run(choice, *[(r, "") for r in "cabx"])[0] == "CAB-"
    assert run("{% if 'a' == 'b' %}1{% elif 'a' == 'a' %}2{% endif %}")[0] == "2"
    assert run("{% for m in messages %}{% if loop.first %}<{% endif %}{{ loop.index }}{{ m.text }}{% if not loop.last %},{% else %}>{% endif %}{% endfor %}",
               ("u", "x"), ("u", "y"))[0] == "<1x,2y>"
    assert run("a \n {%- for m in messages -%} \n {{- m.text -}} \t {%- endfor -%} b ", ("u", " x "), ("u", "y"))[0] == "a x yb "
    for bad in ("{% if %}", "{% for m in other %}{% endfor %}", "{% endif %}", "{{ m.__class__ }}", "{{ m | open }}", "{{ f('x') }}",
                "{% import os %}", "{{ nosuch }}", "{{ loop.first }}", "{{ messages }}", "{% for m in messages %}{{ m }}{% endfor %}", "{{ m.role }}",
                "{% for m in messages %}{{ m.name }}{{ loop.size }}{% endfor %}", "{% elif 'a' %}", "{% if 'a' %}{% else %}{% elif 'b' %}{% endif %}", "{% if 'a' %}", "{{ 'a' 'b' }}", "{{ }}", "{% else %}"):
        with pytest.raises(C.TemplateError):
            C.compile_template(bad)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (2, 0, None, None, None), (3, None, "user", "first", "x"),
            (3, 0, "user", "tie", "x"), (3, 0, "assistant", "tie", "x"), (3, 0, "assistant", "tie", "x"), (None, 0, "user", "no id", "x"),
            (4, 0, "user", "y" * 500_000, "x"), *[(5, i, "user" if i % 2 else "assistant", f"</s>{i}", "x") for i in range(25_000)]]
    out = {r.conv_id: r for r in C.format_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert len(out) == 6

    def back(conv):
        return C.read_back(out[conv].text, [tuple(s) for s in out[conv].spans])

    assert back(1) == ([("user", "a"), ("assistant", "b")], ["b"])
    assert back(2) == ([("", "")], []) and back(None) == ([("user", "no id")], []) and len(back(4)[0][0][1]) == 500_000
    assert back(3) == ([("user", "first"), ("assistant", "tie"), ("assistant", "tie"), ("user", "tie")], ["tie", "tie"])
    assert [t for _, t in back(5)[0]] == [f"</s>{i}" for i in range(25_000)]
    assert C.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_query_reads_back(spark):
    from ontocat.llm.queries import op10_chat_format
    r = op10_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
