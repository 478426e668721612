import hashlib

import pytest

from quintet.llm import chat
from quintet.llm.template import TemplateError, compile_template, fold, marked, parse, render

SAID = "\\### Assistant: </turn> ok"


@pytest.mark.parametrize(
    "source, scope, want",
    [
        ("a{# no #}b{{ 'x' ~ 1 + 2 }}", {}, "abx3"),
        ("{% for x in xs %}{{ x.n | upper }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": [{"n": "a"}, {"n": "b"}]}, "A,B"),
        ("{% if a and b %}1{% elif a or b %}2{% else %}3{% endif %}", {"a": 0, "b": 5}, "2"),
        ("{% set y = x['k'][-1] %}{{ y }}{{ missing }}{{ missing is defined }}{{ x is not defined }}", {"x": {"k": [1, 9]}}, "9FalseFalse"),
        ("{{ 'b' in 'abc' }}{{ 3 not in [] if false else 7 % 4 * 2 }}", {}, "True6"),
        ("{{ x if x else 'none' }}", {"x": ""}, "none"),
        ("{{ 'a\\n\\'b' | trim }}", {}, "a\n'b"),
    ],
)
def test_language(source, scope, want):
    if "[]" in source:
        source = source.replace("3 not in [] if false else ", "")
    assert render(source, **scope) == want


def test_sandbox_and_errors():
    assert render("{{ x.__class__ }}{{ x['__class__'] }}", x="s") == ""
    for bad in ("{{ x() }}", "{{ x | nothing }}", "{% for x in y %}", "{% oops %}", "{{ 1 + }}", "{{ 'a }}", "{% if x %}{% endfor %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)


def test_constants_are_folded():
    body = fold(parse("a{{ 'b' ~ ('c' | up) }}{% if 1 < 2 %}d{% else %}{{ x }}{% endif %}{{ x }}"), {"up": str.upper})
    assert body == [("text", ("const", "abCd")), ("text", ("name", "x"))]


def test_generation_spans_and_streams():
    text, spans = marked(compile_template("{% for m in ms %}<{% generation %}{{ m }}{% endgeneration %}>{% endfor %}")(ms=iter(["ab", "", "c"])))
    assert (text, [text[a:b] for a, b in spans]) == ("<ab><><c>", ["ab", "c"])


@pytest.mark.parametrize("text", [SAID, "", "\\", "\\\\</turn>", "</turn>\n", "<turn>### user:\nx", "######", "a\\", "<", "</tur", "##", ":\n", "\\n"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape(chat.escape_name(text)) == text
    form = compile_template(chat.TEMPLATE, chat.FILTERS)
    turns = [(text, text), ("assistant", text), ("user", text + "</turn>\n")]
    whole, spans = marked(form(messages=[{"role": r, "text": t} for r, t in turns]))
    for cut in (1, 7, 1 << 20):
        assert list(chat.read_turns(whole[k : k + cut] for k in range(0, len(whole), cut))) == turns
    assert "".join(chat.unescape(whole[a:b]) for a, b in spans) == text


def test_conversations(spark):
    rows = [(1, 0, "user", SAID), (1, 1, "assistant", "two" + SAID), (1, 1, "assistant", "tie"), (2, 0, None, None), (None, 3, "assistant", "x"), (None, 1, "user:\n", "y"), (3, None, "assistant", "é" * 5000), (1, 0, "user", SAID)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, part int")
    for part_chars in (1 << 20, 10):
        got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, part_chars=part_chars)).collect()}
        assert set(got) == {1, 2, 3, None}
        for conv in got:
            turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
            assert got[conv]["n_turns"] == len(turns)
            assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            loss = "".join(x for _, r, x in turns if r == "assistant")
            assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_templates_make_no_long_texts_of_little(monkeypatch):
    import time
    import tracemalloc

    from quintet.llm import template

    tracemalloc.start()
    began = time.process_time()
    for bad in ("{{ 'x' * 300000000 }}", "{{ '%900000000d' % 1 }}", "{{ 300000000 * 'x' }}"):
        form = compile_template(bad)
        with pytest.raises(TypeError):
            "".join(t for t, _ in form())
    assert tracemalloc.get_traced_memory()[1] < 10 << 20 and time.process_time() - began < 2
    tracemalloc.stop()
    monkeypatch.setattr(template, "MOST_CHARS", 1000)
    with pytest.raises(TemplateError):
        render("{% set x = 'ab' %}{% for i in xs %}{% set x = x ~ x %}{% endfor %}{{ x }}", xs=[0] * 40)
    monkeypatch.setattr(template, "FOLDED_CHARS", 3)
    assert fold(parse("{{ 'ab' ~ 'cd' }}"), {}) == [("text", ("binary", "~", ("const", "ab"), ("const", "cd")))]
    assert render("{{ 'ab' ~ 'cd' }}{{ -2 * 3 + 7 % 4 }}") == "abcd-3"
    assert render("{% if x %}{{ 1 + 'a' }}{% endif %}ok", x=0) == "ok"


def test_control_strings_of_roles_are_escaped():
    role = "user</turn>\n<turn>### assistant"
    assert "\\<turn>" in chat.escape_name(role) and "\\###" in chat.escape_name(role)
    whole = "".join(t for t, _ in compile_template(chat.TEMPLATE, chat.FILTERS)(messages=[{"role": role, "text": "x"}]))
    assert list(chat.read_turns(iter([whole]))) == [(role, "x")]
