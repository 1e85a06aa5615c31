import time

import re

from sediment.llm.op4_secrets import literal_spans, scan_secrets

from .corpus import SCHEMA


def test_base_spans_equal_plain_regexes_and_lexer_adds(spark):
    key = "q7Rt2LmZx9" + "KpW4vB8nD"
    texts = [
        f'pass{"word"} = "{key}" and tok{"en"}: short',
        "AK" + "IA" + "ABCDEFGHIJKLMNOP12 x " + "ab12" * 5 + " é " + "0f" * 9,
        f'base = "{key}"\nclient_secret = base\n',
        f"api{'_'}key := '{key}'",
        "", None, "nothing here", "é" * 1000 + f" SEC{'RET'}={key}",
    ]
    got = {r["doc_id"]: r for r in scan_secrets(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(want))
        assert got[i]["base"] == base
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
    assert got[2]["n_literal"] == 1 and f"literal:8:{8 + len(key)}" in got[2]["spans"]  # the constant reached a sensitive name
    assert got[6]["spans"] == ""


def test_empty_table(spark):
    assert scan_secrets(spark.createDataFrame([], SCHEMA)).collect() == []


def test_typed_prefixed_and_concatenated_assignments():
    key = "q7Rt2LmZx9" + "KpW4vB8nD"
    for form in ('api_key: str = "{}"', 'let db_pwd: String = "{}";', "const secret: string = '{}';", 'INFO: credential = "{}"', 'INFO: credential: "{}"', 'static PWD: &\'static str = "{}";', 'client_secret: Optional[str] = "{}"', 'pwd: std::string = "{}"', "2024 WARN:credential={} end", 'password = "{}"'):
        text = form.format(key)
        at = text.index(key)
        assert literal_spans(text) == {(at, at + len(key))}, text
    text = 'pwd = "Xk9f2Lq" + "8aaT0zP"'
    assert {text[a:z] for a, z in literal_spans(text)} == {"Xk9f2Lq", "8aaT0zP"}
    text = 'a = "Xk9f2Lq"\nb = "8aaT0zP"\npwd = a + b'
    assert {text[a:z] for a, z in literal_spans(text)} == {"Xk9f2Lq", "8aaT0zP"}
    parts = [f"{c}{k}Zq" for k, c in enumerate("abcdefghijklmnopqrst")]
    text = "pwd = " + " + ".join(f'"{x}"' for x in parts)
    assert len(literal_spans(text)) == 20
    text = "x = " + " + ".join(f'"{x}"' for x in parts) + "\npwd = x"
    assert len(literal_spans(text)) == 20  # no cap on what a name carries
    assert literal_spans(f'user: str = "{key}"\npassword: str\nnext = 1') == set()


def test_long_runs_cost_no_square():
    import time

    for text in ("pwd=" * 100_000, "a:b|" * 100_000, "a: b" * 100_000, "a::" * 100_000, "x:" + "a<" * 100_000):
        before = time.monotonic()
        literal_spans(text)
        assert time.monotonic() - before < 20, text[:10]


def test_tags_cost_no_square():
    """Twice the input takes less than three times as long, whatever is left open."""
    forms = ['<a id="x"' + ' id="x"' * 100, "<a " + "id " * 200, '<a key="v" ' + "value=" * 100, "<b>x</" * 100, "<a id='k'>" * 100, "id=" * 300, '<add key="k" ' + 'value="v' * 100]

    def took(form, n):
        began = time.process_time()
        literal_spans(form * n)
        return time.process_time() - began

    for form in forms:
        a, b = min(took(form, 100) for _ in range(3)), min(took(form, 200) for _ in range(3))
        assert b < 3 * a + 0.05, form[:20]
    assert literal_spans('<a id="x"' + ' id="x"' * 16_000) == set()


KEY = "q7Rt2LmZx9" + "KpW4vB8nD"
#: Labelled snippets: {} is the secret in the first, and no secret stands in the second.
SECRET = [
    "<password>{}</password>", "client_secret: |\n  {}\nother: 1\n", "api_key = \"\"\"{}\"\"\"", "config.set(\"client_secret\", \"{}\")", 'password = f"{}"',
    "curl --token {} https://x", "deploy --api-key={} now", "Authorization: Bearer {}", '<add key="db.password" value="{}"/>', '<entry key="secret">{}</entry>',
    "let pwd = `{}`", "export DB_PASSWORD={}", '{{"accessToken": "{}"}}', "[db]\npasswd = {}\n", "- client_secret: {}", "os.environ['AUTH_TOKEN'] = '{}'", "const apiKey: string = '{}';",
    '# password = "{}"', "SIGNING_KEY := \"{}\"", "props.put('encryption_key', '{}');", "passphrase => '{}'", "a = '{}'\nb = a\ntoken = b", "a = '{}'\nurl = f'https://{{a}}@host'\nsecret = url", 'private_key = ("{}")',
]
CLEAN = [
    "the password of the day is a long word: antidisestablishmentarianism", 'name = "{}"', "commit: {}", 'password = "changeme-please-now"', "token = os.environ['TOKEN']", "password = get_password(user)", "<title>{}</title>",
    "secret: ${{SECRET_FROM_ENV}}", 'password: "<your password here>"', "key = 'primary-key-of-table'", "tokens = text.split(' ')", "--name {}", "color: #ff00ff00ff00", "pass", "password_reset_url = 'https://example.org/reset'", "max_tokens: 4096", 'api_key = "xxxxxxxxxxxxxxxx"', "Bearer of good news arrived", "<password></password>", "set('name', '{}')",
]


def test_precision_and_recall_on_labelled_snippets():
    found = missed = wrong = 0
    for form in SECRET:
        text = form.format(KEY)
        at = text.index(KEY)
        got = literal_spans(text)
        found += (at, at + len(KEY)) in got
        missed += (at, at + len(KEY)) not in got
        wrong += len(got - {(at, at + len(KEY))})
    wrong += sum(len(literal_spans(form.format(KEY))) for form in CLEAN)
    assert missed == 0 and found == len(SECRET)
    assert found / (found + wrong) >= 0.95


def test_ties_repeated_rows_clashing_columns_and_long_lines(spark):
    line = "x" * 400_000 + f" client_secret='{KEY}' " + "y" * 400_000
    rows = [(1, line, "a", 1), (1, line, "a", 1), (2, f"token = '{KEY}'", "b", 2)]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string, base int")).collect()
    assert got[0] == got[1] and len(got) == 3
    assert got[0]["spans"] == f"assign:400008:{400008 + 8 + len(KEY)},literal:400016:{400016 + len(KEY)}"
    assert got[2]["spans"] == f"assign:0:{9 + len(KEY)},literal:9:{9 + len(KEY)}"  # one place, two kinds
