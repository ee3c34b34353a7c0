import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from portolan.llm import bitpack as B
from portolan.llm import chat as C
from portolan.llm.tokens import PIECES, tokenizer

TURNS = "conv_id long, turn long, role string, text string"


def render(source, **context):
    return C.Template(source).render(**context)[0]


@pytest.mark.parametrize(
    "source, want",
    [
        ("a{{ 1 + 2 * 3 }}b", "a7b"), ("{{ 'x' ~ 1 ~ none }}", "x1None"), ("{{ (1 + 2) * 3 // 2 }}", "4"), ("{% if a and not b %}y{% elif c %}z{% else %}n{% endif %}", "y"),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q"), ("{% for x in [] %}a{% else %}none{% endfor %}", "none"), ("{% for x in xs if x != 'p' %}{{ x }}{{ loop.first }}{% endfor %}", "qTrue"),
        ("{% set y = xs[0] %}{{ y | upper }}", "P"), ("{{ xs[1:] | join('-') }}{{ xs[-1] }}{{ xs[:1] | length }}", "qq1"), ("{{ missing is defined }} {{ d.k is string }} {{ d['k'] }}", "False True v"), ("{{ missing | default('none') }}", "none"),
        ("a  {%- if a -%}  b  {%- endif -%}  c", "abc"), ("{# note #}t{{ 'a' if b else 'c' }}", "tc"), ("{{ 'p' in xs }}{{ 'z' not in xs }}", "TrueTrue"), (r"{{ 'a\n\'b' }}", "a\n'b"), ("{{ -3 % 2 }}{{ 1.5 + 1 }}", "12.5"), ("{{ d | tojson }}", '{"k": "v"}'),
        ("{{ 1 < 2 and 2 >= 2 }}{{ 'A' == 'A' }}", "TrueTrue"), ("{% for a, b in ps %}{{ a }}{{ b }};{% endfor %}", "12;34;"), ("", ""), ("{{ ' x ' | trim | replace('x', 'yy') }}", "yy"),
    ],
)
def test_language(source, want):
    assert render(source, a=True, b=False, c=True, xs=["p", "q"], d={"k": "v"}, ps=[[1, 2], [3, 4]]) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("{{ ' a b '.strip().upper() }}{{ 'x,y'.split(',')[1] }}", "A By"), ("{% set ns = namespace(n=0, s='') %}{% for x in xs %}{% set ns.n = ns.n + 1 %}{% set ns.s = x ~ ns.s %}{% endfor %}{{ ns.n }}{{ ns.s }}", "2qp"),
        ("{{ {'a': {'b': [1, 2]}}['a']['b'][1] }}{{ {'a': 1}.get('z', 7) }}", "27"), ("{% macro say(a, b='!') %}<{{ a }}{{ b }}>{% endmacro %}{{ say('x') }}{{ say('y', b='?') }}{{ say(b=1, a=2) }}", "<x!><y?><21>"),
        ("{{ d | tojson(indent=2) }}", '{\n  "k": "v"\n}'), ("{% set t %}a{{ 1 }}{% endset %}[{{ t }}]", "[a1]"), ("{% for k, v in d.items() %}{{ k }}={{ v }}{% endfor %}", "k=v"), ("{{ '}}' ~ \"%}\" ~ '{{' }}", "}}%}{{"),
        ("{{ ms | selectattr('r', 'equalto', 'u') | map(attribute='t') | join('+') }}{{ ms | map(attribute='r') | list | length }}", "1+33"), ("{{ 'u' is eq 'u' }}{{ 3 is divisibleby(3) }}{{ 2 is in [1, 2] }}{{ 'ab'.startswith('a') and not 'ab'.endswith('a') }}", "TrueTrueTrueTrue"),
        ("{{ 'aXbXc'.replace('X', '-', 1) }}{{ xs | first }}{{ {} | length }}{{ dict(a=1).keys() | join }}", "a-bXcp0a"), ("{% for i in range(2) -%}\n {{ i }}\n{%- endfor %}", "01"), ("{{ 'a\nb' | indent(2) }}", "a\n  b"),
    ],
)
def test_what_templates_in_use_need(source, want):
    assert render(source, xs=["p", "q"], d={"k": "v"}, ms=[{"r": "u", "t": 1}, {"r": "a", "t": 2}, {"r": "u", "t": 3}]) == want


HEADERS = """{{- bos_token }}
{%- if tools %}
    {{- "tools: " + (tools | tojson) + "\n" }}
{%- endif %}
{%- set ns = namespace(last=-1) %}
{%- for m in messages %}
    {%- if m['role'] == 'user' %}{% set ns.last = loop.index0 %}{% endif %}
{%- endfor %}
{%- for message in messages %}
    {% if not (message.role in ['user', 'assistant', 'system']) %}
        {{ raise_exception('Unknown role: ' ~ message.role) }}
    {% endif %}
    {%- if message.role == 'assistant' %}
        {{- '<|start|>assistant<|end|>' }}{% generation %}{{ message['content'].strip() + eos_token }}{% endgeneration %}
    {%- else %}
        {{- '<|start|>' + message['role'] + '<|end|>' + message['content'] | trim }}{{ '*' if loop.index0 == ns.last else '' }}
    {%- endif %}
{%- endfor %}
{%- if add_generation_prompt %}
    {{- '<|start|>assistant<|end|>' }}
{%- endif %}"""


def test_a_template_as_models_have_it(spark):
    rows = [(1, 0, "system", " be kind "), (1, 1, "user", "hi"), (1, 2, "assistant", " hello "), (1, 3, "user", "bye"), (2, 0, "tool", "x")]
    out = C.format_conversations(spark.createDataFrame(rows, TURNS), HEADERS, context={"bos_token": "<s>", "eos_token": "</s>", "tools": [{"name": "f"}], "add_generation_prompt": True}, trim_blocks=True, lstrip_blocks=True)
    got = {r["conv_id"]: r for r in out.collect()}
    assert got[1]["text"] == '<s>tools: [{"name": "f"}]\n<|start|>system<|end|>be kind<|start|>user<|end|>hi<|start|>assistant<|end|>hello</s><|start|>user<|end|>bye*<|start|>assistant<|end|>'
    assert [got[1]["text"][x["start"] : x["end"]] for x in got[1]["generated"]] == ["hello</s>"]
    assert got[2]["text"] is None and got[2]["error"] == "Unknown role: tool"


def test_trimmed_blocks():
    source = "a\n  {% if true %}\n  b\n  {% endif %}\n{# c #}\nd {{ 1 }}\n"
    assert C.Template(source).render()[0] == "a\n  \n  b\n  \n\nd 1\n"
    assert C.Template(source, True, True).render()[0] == "a\n  b\nd 1\n"


def test_a_very_long_conversation_is_rendered_whole():
    text, _ = C.Template(C.CHATML).render(messages=[{"role": "user", "content": "x" * 60_000_000}])
    assert len(text) > 60_000_000


@pytest.mark.parametrize("source", ["{% macro m(n) %}{{ m(n) }}{{ m(n) }}{% endmacro %}{{ m(1) }}", "{{ 'a'.format(1) }}", "{{ x.mro() }}", "{% set x.y = 1 %}", "{{ [1].append(2) }}", "{{ 'x' | map('nothing') }}", "{{ 'aa'.replace('a', 'b' * 40000000) }}", "{{ say() }}", "{% macro m(a) %}{% endmacro %}{{ m(1, 2) }}", "{{ 'a'", "{% if '%}' "])
def test_new_ways_are_bounded(source):
    with pytest.raises(C.TemplateError):
        render(source, x={"a": 1})


def test_bounds_leave_long_input_whole(monkeypatch):
    monkeypatch.setattr(C, "LONGEST", 1000)
    monkeypatch.setattr(C, "MOST_STEPS", 10, raising=False)
    ms = [{"role": "user", "content": "x" * 5000}] + [{"role": "assistant", "content": ""}] * 500
    text, spans = C.Template(C.CHATML).render(messages=ms)
    assert text.count("x" * 5000) == 1 and text.count("<|im_end|>") == 501 and len(spans) == 500
    for source in ("{{ 'a' * 100000 }}", "{% for i in range(1000) %}{% for j in range(1000) %}{{ m }}{% endfor %}{% endfor %}"):
        with pytest.raises(C.TemplateError):
            C.Template(source).render(m="x")


def test_lost_conversations_are_not_silent(spark, tmp_path, monkeypatch):
    from portolan.llm import queries

    spark.createDataFrame([(1, 0, "user", "hello")], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op8_chat_format(spark, str(tmp_path)).first()["text"] == "<|im_start|>user\nhello<|im_end|>\n"
    format_ = C.format_conversations
    monkeypatch.setattr(C, "format_conversations", lambda turns: format_(turns, "{{ raise_exception('no') }}"))
    with pytest.raises(Exception, match="not rendered"):
        queries.op8_chat_format(spark, str(tmp_path)).collect()


def test_generation_spans():
    t = C.Template("<{% for m in ms %}{% if m.r %}{% generation %}{{ m.t }}{% endgeneration %}{% else %}{{ m.t }}{% endif %}|{% endfor %}>")
    text, spans = t.render(ms=[{"r": 0, "t": "user"}, {"r": 1, "t": "bot"}, {"r": 1, "t": ""}])
    assert text == "<user|bot||>" and [text[a:b] for a, b in spans] == ["bot", ""]


def test_constants_are_folded():
    assert C.fold(C.parse("a{{ 1 + 2 }}b{% if 1 > 2 %}{{ x }}{% else %}c{% endif %}")) == C.Node("block", None, (C.Node("text", "a3bc"),))
    assert C.fold(C.parse("{% if x %}{{ 1 / 0 }}{% endif %}")).parts[0].kind == "if"
    assert render("{% if false %}{{ 1 / 0 }}{% endif %}ok") == "ok"


@pytest.mark.parametrize("source", ["{{ ''.__class__ }}", "{{ x.__init__ }}", "{{ xs.append }}", "{{ 'a'['__len__'] }}"])
def test_no_way_to_python(source):
    try:
        assert render(source, x={"a": 1}, xs=[1]) == ""
    except C.TemplateError:
        pass


@pytest.mark.parametrize("source", ["{{ open('/etc/passwd') }}", "{% import os %}", "{{ 1 + }}", "{% for x in y %}", "{{ x | nofilter }}", "{% if %}a{% endif %}", "{{ x is odder }}", "{{ `a` }}", "{{ f(1) }}", "{{ x[] }}"])
def test_wrong_templates(source):
    with pytest.raises(C.TemplateError):
        render(source, x=1, y=[])


@pytest.mark.parametrize("source", ["{{ raise_exception('no') }}", "{{ 1 / 0 }}", "{{ 'a' * 999999999 }}", "{{ missing.x }}", "{{ 'a' + 1 }}", "{{ '%s' % 1 }}", "{% for i in range(99999999) %}{% endfor %}"])
def test_errors_when_rendered(source):
    with pytest.raises(C.TemplateError):
        render(source)


def test_conversations(spark):
    rows = [(1, 1, "assistant", " hi "), (1, 0, "user", "hello"), (2, 0, None, None), (None, 0, "user", "x"), (3, 0, "user", "tie b"), (3, 0, "user", "tie a"), (3, 0, "user", "tie a"), (4, None, "user", "first"), (2**60 + 1, 0, "user", "big"), (4, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("m", F.lit(1)).withColumn("messages", F.lit("mine"))
    got = {str(r["conv_id"]): r for r in C.format_conversations(df).collect()}
    assert got["1"]["text"] == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
    assert [got["1"]["text"][s["start"] : s["end"]] for s in got["1"]["generated"]] == ["hi<|im_end|>"]
    assert got["2"]["text"] == "<|im_start|>unknown\n<|im_end|>\n" and got["None"]["n_messages"] == 1 and str(2**60 + 1) in got
    assert got["3"]["text"].count("tie a") == 2 and got["3"]["text"].index("tie a") < got["3"]["text"].index("tie b")
    assert got["4"]["text"].startswith("<|im_start|>user\nfirst") and len(got["4"]["text"]) > 200_000
    assert C.format_conversations(df.limit(0)).count() == 0
    bad = C.format_conversations(df.filter("conv_id = 1"), "{% for m in messages %}{{ raise_exception('role ' + m.role) }}{% endfor %}").first()
    assert bad["text"] is None and bad["error"] == "role user"
    with pytest.raises(C.TemplateError):
        C.format_conversations(df, "{% nothing %}")


def test_chatml_same_as_sql(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    mine = C.format_conversations(df).orderBy("conv_id").toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    theirs = db.execute(C.chatml_sql() + " ORDER BY conv_id").df()
    assert mine["text"].tolist() == theirs["text"].tolist()
    assert [",".join(f"{s['start']}:{s['end']}" for s in g) for g in mine["generated"]] == theirs["generated"].tolist()


# Bits


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**32 - 1))
def test_pack_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64)
    data = B.pack_ids(ids, bits)
    assert len(data) == -(-n // 64) * bits * 8
    assert B.unpack_ids(data, bits, n).tolist() == ids.tolist()
    whole = int.from_bytes(data, "little")  # the layout: id i is bits i*bits to (i+1)*bits - 1
    assert [whole >> i * bits & (1 << bits) - 1 for i in range(n)] == ids.tolist() and whole >> n * bits == 0


def test_bits_and_limits():
    assert [B.bits_for(v) for v in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    for wrong in ([4], [-1]):
        with pytest.raises(ValueError):
            B.pack_ids(np.array(wrong), 2)
    with pytest.raises(ValueError):
        B.bits_for(0)


@pytest.mark.parametrize("vocabulary", [32_000, 65_536, 100_000])
def test_documents_come_back(docs, vocabulary):
    p = B.TokenParams(vocabulary=vocabulary, block_ids=64, shard_ids=700)
    pairs = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "naïve café 😀\n\n  x"), (5, "<|endoftext|>"), (2**60 + 1, "big")] + [(10 + i, f"text {i} " * i) for i in range(60)] + [(99, "long text " * 5000), (100, " " * 1_000_000 + "x")]
    enc = tokenizer("model", open(PIECES, "rb").read())
    back = []
    for r in B.pack_documents(docs(pairs).repartition(3), p).collect():
        x = B.PackedIds(r["bits"], r["block_ids"], r["n_tokens"], np.array(r["block_offsets"]), bytes(r["data"]))
        every = x.all()
        assert len(every) == r["n_tokens"] and len(r["data"]) == r["block_offsets"][-1] and r["bits"] == B.bits_for(vocabulary)
        for i, k in enumerate(r["doc_ids"]):
            a, b = r["doc_starts"][i], r["doc_starts"][i + 1]
            ids = x.slice(a, b)
            assert ids.tolist() == every[a:b].tolist() and ids[-1] == p.end_id
            back.append((str(k), enc.decode(ids[:-1].tolist())))
    assert sorted(back) == sorted((str(k), t or "") for k, t in pairs)
    assert B.pack_documents(docs([]), p).count() == 0
