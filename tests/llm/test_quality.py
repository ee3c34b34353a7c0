import duckdb
from conftest_llm import keep_extra
from pyspark.sql import functions as F

from portolan.llm import quality as Q
from portolan.llm.quality import clean_lines, clean_lines_sql

GOOD = "The quick brown fox jumps over the lazy dog. It sleeps then."


def run(docs, pairs, **kw):
    out = clean_lines(docs(pairs), **kw)
    return {r["doc_id"]: r for r in out.collect()}


def test_rules_take_lines_out(docs):
    bad = ["home | about | contact | more", "Home", "All rights reserved.", "Licensed under the MIT License.", "no mark at the end of this", "STOP!! THIS!! NOW!!", "a$$$ b%%% c### d&&&.", "Read more", "go go go go go go go go go go go go."]
    got = run(docs, [(1, "\n".join([GOOD * 9, *bad, GOOD]))])
    assert got[1]["text"] == GOOD * 9 + "\n" + GOOD
    assert got[1]["n_chars"] == len(got[1]["text"])


def test_documents_that_lose_too_much_go(docs):
    half = "x" * 30
    assert not run(docs, [(1, GOOD + "\n" + half * 10)])
    assert 1 in run(docs, [(1, GOOD + "\n" + half * 10)], max_lost=0.9)
    exactly = "Twenty characters ab." + "\n" + "y" * 21
    assert 1 in run(docs, [(1, exactly)])  # half is not more than half


def test_nulls_blanks_and_repeats(docs):
    df = docs([(1, None), (2, ""), (3, " \n\t\n"), (4, GOOD), (4, GOOD), (None, GOOD), (5, GOOD + "\r\n" + GOOD)])
    out = clean_lines(df)
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == sorted([("4", GOOD), ("4", GOOD), ("None", GOOD), ("5", GOOD + "\n" + GOOD)])
    keep_extra(out, df)


def test_long_text_and_empty_table(docs):
    long = "\n".join([GOOD] * 30_000)
    assert run(docs, [(1, long)])[1]["text"] == long
    one_line = GOOD * 20_000
    assert run(docs, [(1, one_line)])[1]["text"] == one_line
    assert clean_lines(docs([])).count() == 0


def test_same_as_sql(spark, sf):
    mine = clean_lines(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().sort_values("doc_id").reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    theirs = db.execute(clean_lines_sql()).df().sort_values("doc_id").reset_index(drop=True)
    assert (mine[theirs.columns] == theirs).all().all() and len(mine) == len(theirs) > 0


def plain_rules(line, max_symbols=0.1, max_repeats=0.5, repeat_from=10):
    """``line_passes`` by its patterns alone."""
    words = F.split(line, " ", -1)
    repeats = F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a == b), lambda x: x)
    shouted = (F.length(F.regexp_replace(line, Q.LETTERS, "")) >= 4) & (F.upper(line) == line) & (F.lower(line) != line) & ((F.size(words) >= 5) | line.contains("!!"))
    return (
        (line.rlike(Q.TERMINAL) | line.rlike(Q.SENTENCE)) & (F.length(F.regexp_replace(line, Q.SYMBOLS, "")) >= F.length(line) * F.lit(1.0 - max_symbols)) & ~shouted
        & ~line.rlike(Q.NAVIGATION) & ~line.rlike(Q.BOILERPLATE) & ((F.size(words) < repeat_from) | (F.size(repeats) <= F.size(words) * F.lit(max_repeats)))
    )


def test_cheap_tests_change_nothing_and_save_time(spark, sf):
    import time

    stock = ["All Rights RESERVED", "copyright (C)", "Copyright ©", "Copyright 2", "licensed under", "Released Under", "Privacy policy", "terms of use", "terms of service", "cookie policy", "cookie settings", "accept cookies", "accept all cookies", "we use cookies", "subscribe to our", "cLick here", "clic\u212a here", "enable javascript", "JavaScript is disabled", "powered by", "lorem ipsum", "reserved", "terms of war"]
    menu = ["Home", "skip to content", "Skip to content ", "Back to top", "a | b | c.", "a » b » c.", "a > b > c.", "a · b · c.", "a | b.", "logs"]
    odd = ["", " ", "…", "End.", "End.”)", "End ", "End.\u0085", "One. Two", "STOP IT NOW!!", "THIS IS ALL IN CAPITALS.", "ÀÉÎÕ ÀÉÎÕ A B C.", "1 2 3 4 5!", "a" + " a" * 9 + ".", "a b a b a b a b a b a.", "a a b b c c d d e e f.", "a a a a a a b c d e f g.", "  ".join("abcdefghij") + ".", "## $$ x.", "x # y z and more words."]
    lines = spark.createDataFrame([(x,) for x in odd + menu + [f"Well, {x} indeed." for x in stock] + stock], "x string")
    for args in ((0.1, 0.5, 10), (0.3, 0.37, 3)):
        got = lines.select("x", Q.line_passes(F.col("x"), *args).alias("mine"), plain_rules(F.col("x"), *args).alias("plain")).collect()
        assert [(r["x"], r["mine"]) for r in got] == [(r["x"], r["plain"]) for r in got] and len({r["mine"] for r in got}) == 2
    many = spark.read.parquet(f"{sf}/documents.parquet").select(F.split("text", "\n").alias("ls")).crossJoin(spark.range(3)).coalesce(1).cache()
    many.count()
    took = {}
    for name, rule in (("plain", lambda x: plain_rules(x)), ("mine", lambda x: Q.line_passes(x, 0.1, 0.5, 10))):
        for _ in range(2):
            began = time.time()
            many.agg(F.sum(F.size(F.filter("ls", rule)))).first()
            took[name] = min(took.get(name, 1e9), time.time() - began)
    many.unpersist()
    assert took["mine"] < 0.85 * took["plain"], took
