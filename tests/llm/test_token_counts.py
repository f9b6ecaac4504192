import public_tokenizers as P
import pytest
from tillroll.llm import queries, token_counts
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def plain(text, bounds, rule):
    """Tokens of each section, one token after the other."""
    counts = [0] * (len(bounds) - 1)
    for a, b in LIBRARY.encode(text, add_special_tokens=False).offsets:
        shares = [max(0, min(b, bounds[i + 1]) - max(a, bounds[i])) for i in range(len(counts))]
        inside = [i for i, s in enumerate(shares) if s]
        counts[{"first": inside[0], "last": inside[-1], "most": max(inside, key=lambda i: (shares[i], -i))}[rule]] += 1
    return counts


def line_bounds(text):
    bounds = [0]
    for line in text.splitlines(keepends=True) if not set(text) & set("\r\v\f\x1c\x1d\x1e\x85\u2028\u2029") else []:
        bounds.append(bounds[-1] + len(line))
    return bounds if len(bounds) > 1 else [0, len(text)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines(spark, small, rule):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in token_counts.count_line_tokens(docs, rule=rule).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["start"], r["end"], r["n_tokens"])
    for i, text in texts.items():
        bounds = line_bounds(text)
        counts = plain(text, bounds, rule)
        assert [got[i][k] for k in range(len(counts))] == list(zip(bounds[:-1], bounds[1:], counts, strict=True))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_crossing(spark, rule):
    text = "one\n\n\n\ntwo  \n\n é\n"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted(token_counts.count_line_tokens(df, rule=rule).collect(), key=lambda r: r["section"])
    assert [r["n_tokens"] for r in rows] == plain(text, line_bounds(text), rule)
    assert sum(r["n_crossing"] for r in rows) > 0


def test_fields(spark):
    df = spark.createDataFrame([(1, "Title", "some body é 😀", ""), (2, None, None, "x")], "id long, title string, body string, tail string")
    rows = sorted((r["doc_id"], r["section"], r["start"], r["end"], r["n_tokens"]) for r in token_counts.count_field_tokens(df, ["title", "body", "tail"], "id").collect())
    for i, fields in ((1, ["Title", "some body é 😀", ""]), (2, ["", "", "x"])):
        text, bounds = "\n".join(fields), [0]
        for k, f in enumerate(fields):
            bounds.append(bounds[-1] + len(f) + (k < 2))
        assert [r[4] for r in rows if r[0] == i] == plain(text, bounds, "first")
        assert [r[2:4] for r in rows if r[0] == i] == list(zip(bounds[:-1], bounds[1:], strict=True))


def test_odd_rows(odd, odd_rows, none):
    total = {}
    for r in token_counts.count_line_tokens(odd).collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    want = {}
    for i, t, _ in odd_rows:
        want[i] = want.get(i, 0) + len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
    assert total == want
    assert token_counts.count_line_tokens(none).count() == 0
    with pytest.raises(ValueError, match="rule"):
        token_counts.count_line_tokens(odd, rule="none")


def test_query(spark, small):
    rows = queries.op3_token_counts(spark, small)
    assert rows.where("section = 0").count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_fields_of_odd_rows(spark, odd, none, odd_rows):
    rows = token_counts.count_field_tokens(odd, ["text", "lang", "n"], "doc_id").collect()
    assert len(rows) == 3 * len(odd_rows)
    of = lambda i: sorted((r["section"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
    assert [s for s, _ in of(2)] == [0, 1, 2] and of(2)[1][1] <= 1  # null fields count as empty
    assert of(5)[::2] == of(5)[1::2]  # repeated rows are counted each by itself
    assert sum(n for s, n in of(6) if s == 0) > 30_000
    assert token_counts.count_field_tokens(none, ["text", "lang"]).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_field_tokens(odd, [])
