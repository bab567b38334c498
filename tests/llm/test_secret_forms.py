"""Forms of assignment, each in scan and redacted."""

from __future__ import annotations

import pytest

from odlake.llm import secrets

FORMS = [
    ('api_token: str = "s3cr3tValue99"', "s3cr3tValue99"),
    ("const clientSecret: string = 's3cr3tValue99'", "s3cr3tValue99"),
    ('let pwd: String = "s3cr3tValue99";', "s3cr3tValue99"),
    ('let pwd: &\'static str = "s3cr3tValue99";', "s3cr3tValue99"),
    ('pwd: Optional[str] = "s3cr3tValue99"', "s3cr3tValue99"),
    ('val pwd: Map<String, List<String>> = "s3cr3tValue99"', "s3cr3tValue99"),
    ('pwd: string | null = "s3cr3tValue99"', "s3cr3tValue99"),
    ('var pwd string = "s3cr3tValue99"', "s3cr3tValue99"),
    ("x: 1\npwd: correcthorsebattery\ny: 2", "correcthorsebattery"),
    ("passphrase = correcthorsebattery", "correcthorsebattery"),
    ("export DB_PWD=correct!horse$battery9 # old", "correct!horse$battery9"),
    ("pwd: !correct,horse#9", "!correct,horse#9"),
    ('config["db"]["pwd"] = "s3cr3tValue99"', "s3cr3tValue99"),
    ('"pwd" => "s3cr3tValue99",', "s3cr3tValue99"),
    ('a = pwd = b = "s3cr3tValue99"', "s3cr3tValue99"),
    ('pwd = b"s3cr3tValue99"', "s3cr3tValue99"),
    ('pwd = """\ns3cr3tValue99\n"""', "s3cr3tValue99"),
    ("pwd: `s3cr3t\\`Value99`", "s3cr3t\\`Value99"),
    ("pwd: |\n  s3cr3tValue99\nother: 1", "s3cr3tValue99"),
    ('x = "s3cr3tValue99"\ny = x\nz = y\nself.pwd = z', "s3cr3tValue99"),
    ('connect(user="me", pwd="s3cr3tValue99")', "s3cr3tValue99"),
    ('run --pwd=s3cr3tValue99 x', "s3cr3tValue99"),
]
#: Literals put together; each part is a span.
TOGETHER = [
    ('pwd = "s3cr3t" + "Value99"', ["s3cr3t", "Value99"]),
    ('pwd = ("s3cr3t"\n       "Value99")', ["s3cr3t", "Value99"]),
    ('HALF = "s3cr3t"\npwd = HALF + "Value99"', ["s3cr3t", "Value99"]),
    ('a = "s3cr3t"\na += "Value99"\npwd = "x1" . "Value99"', ["x1", "Value99"]),
    ('pwd = "s3cr3t" \\\n  "Value99"', ["s3cr3t", "Value99"]),
]
NONE = ["pwd: str", "pwd = read_line()", "call(pwd=correcthorsebattery)", "pwd = someVariable;", "pwd: ${PWD_OF_DB}", "the pwd: correcthorsebattery is said", "pwd: [a, b, c]", "pwd: Optional[str] == other", "pwd = os.environ['X']", "call(pwd=settings.value)", 'if pwd == "s3cr3tValue99":', 'pwd != "s3cr3tValue99"', "std::pwd::s3cr3tValue99", 'pwd = "', "pwd = \"unclosed9\n\""]


def test_forms(spark):
    rows = [(k, t, s) for k, (t, s) in enumerate([*FORMS, *((t, None) for t in NONE)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secret string")
    scanned = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    for k, t, s in rows:
        if s is None:
            assert scanned[k] == [] and clean[k] == t, t
        else:
            assert f"literal:{t.index(s)}:{t.index(s) + len(s)}" in scanned[k] and s not in clean[k], t


def test_literals_put_together():
    for t, parts in TOGETHER:
        assert {t[s:e] for s, e in secrets.lexed(t)} == set(parts), t


LONG = 4_000_000
SHAPES = ["a.", "a-", "'", '"', "(", "[", "'\"[(", "a ", " ", "\n", "b.c[", "\\", "`", "secret", "secret "]
DENSE = ["=", ":", "x=(\n", "a: b ", "=`", "=\"", "='''", "a=a+a\n", "x: |\n  "]  # an operator every few characters


@pytest.mark.parametrize("shape", SHAPES)
def test_very_long_texts_take_linear_time(shape):
    import time

    for most, text in ((2, "pwd " + shape * (LONG // len(shape)) + " x:"), (10, "pwd = " + shape * (LONG // len(shape)) + "="), (10, "pwd=" + (shape + "=" + shape * 400) * (LONG // len(shape) // 400))):
        began = time.process_time()
        secrets.spans(text)
        assert time.process_time() - began < most


@pytest.mark.parametrize("shape", DENSE)
def test_time_doubles_with_the_pairs(shape):
    import time

    took = []
    for n in (250_000, 1_000_000):
        began = time.process_time()
        secrets.spans("pwd " + shape * (n // len(shape)) + "x=1")
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1


def test_very_long_text_of_many_pairs():
    text = 'pwd = "abcdEF123" + pwd\n' * 20_000
    kinds = [k for _, k, _ in secrets.spans(text)[1]]
    assert kinds == [3] * 20_000
    assert secrets.spans("a=a+a\n" * 50_000 + "pwd=a")[1] == []
