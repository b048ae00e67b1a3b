"""Secret scan: base spans by the plain patterns, novelty by example."""
import hashlib
import random
import re

from tests.llm.conftest import CLASH, docs_of
from tijara.llm import queries, secrets_scan as S

PLAIN = [("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(1)) >= 8),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16),
         ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 32)]


def base(text):
    spans = [(m.start(), k, m.end()) for k, p, ok in PLAIN for m in p.finditer(text or "") if ok(m)]
    spans.sort(key=lambda s: (s[0], S.KINDS.index(s[1])))
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


r = random.Random(2)
HEX = "".join(r.choices("0123456789abcdef", k=40))
B64 = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=40))
ROWS = [(1, None), (2, ""), (3, f'é token = "{HEX}" end'), (4, "token: short PASSWORD='longenough1' api_key=abcdefgh apikey:=x"),
        (5, f"AKIA{'Q' * 16} AKIASHORT akia{'q' * 20}"), (6, HEX * 5), (7, "deadbeef" * 4 + "g" + "0" * 31), (8, "token token=token=token=abc12345678"),
        (9, "ſecret=abcdefgh12 toKen=abcdefgh12"), (10, "x " * 60_000 + f"secret={HEX}"), (11, f"{HEX[:20]}"), (12, f"{HEX[12:]}{HEX[:8]}"),
        (None, f"api_key = {HEX}"), (13, f"aws_secret_access_key {B64} more"), (14, f"the quick {B64} fox"),
        (15, "private path /usr/local/lib/python3/site-packages/name"), (16, "token token_token_token1_token_token1_token"), (3, f'é token = "{HEX}" end'),
        (17, "password: 日本語 abcdefgh password: abcdefgh日本語")]


def run(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return queries.op9_secret_scan(spark, str(tmp_path)).collect()


def test_base_spans_and_counts(spark, tmp_path):
    got = run(spark, docs_of(spark, ROWS, CLASH), tmp_path)
    assert len(got) == len(ROWS)
    texts = dict(ROWS)
    for row in got:
        want = base(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (row, want)
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))
        assert ",".join(s for s in row.spans.split(",") if not s.startswith("novel")) == want
        starts = [int(s.split(":")[1]) for s in row.spans.split(",") if s]
        assert starts == sorted(starts)


def test_novelty(spark, tmp_path):
    got = {row.doc_id: row for row in run(spark, docs_of(spark, ROWS), tmp_path)}
    text = dict(ROWS)[13]
    assert got[13].spans == f"novel:{text.index(B64)}:{text.index(B64) + 40}"
    assert got[14].n_novel == got[15].n_novel == got[16].n_novel == got[3].n_novel == 0
    repeated = f"secret first {B64} and again {B64}"
    assert S.novel_spans(repeated, []) == []  # the context explains it


def test_whole_table(spark, documents):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {row.doc_id: row.spans for row in S.scan(df).collect()}
    for i, t in zip(documents.doc_id, documents.text):
        spans = [(s.kind, s.start, s.end) for s in got[i] if s.kind != "novel"]
        assert S.joined(spans) == base(t)


def test_empty(spark):
    assert S.scan(docs_of(spark, [])).count() == 0


def test_keys_of_every_alphabet_on_both_sides():
    """Compressibility decides on each candidate, not its digits or letters."""
    rnd = random.Random(5)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters in (upper + "234567", lower + "0123456789", lower, upper, lower + upper, lower + upper + "0123456789"):
        for n in (16, 20, 26):
            for _ in range(20):
                key = "".join(rnd.choices(letters, k=n))
                for text in (f"our private key {key} is", f'{{"value": "{key}", "type": "api_key"}}'):
                    a = text.index(key)
                    assert S.novel_spans(text, S.base_spans(text)) == [("novel", a, a + n)], text
    for words in ("internationalization", "responsibilities", "/usr/share/images/repository/name", "authentication-service.internal",
                  "well-established", "http.server.request.handler", "Telecommunications"):
        assert S.novel_spans(f"the private {words} of the token", []) == []
