"""Quality rules, URL rules and chat formatting."""

import pytest
from pyspark.sql import functions as F

from penmark.llm import chat, quality, urls


def test_statistics(spark):
    text = "a b c a b c d\n\n x# \n x# \na&é 漢 <|>"
    rows = spark.createDataFrame([(1, text, 3), (2, None, 3), (3, "", 3), (4, " \n \n", 3), (None, "a", 3)], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r)[1:] for r in quality.statistics(rows).collect()}
    assert got[1] == (12, 18, 6, 1, 6)
    assert got[2] == got[3] == got[4] == (0, 0, 0, 0, 0) and got[None] == (1, 1, 0, 0, 0)


def test_rules_are_learned_and_applied(spark):
    rows = [(i, 100 + i % 7, 500, 300 if i % 5 == 0 else i % 3, 0, 0, 0 if i % 5 == 0 else 1) for i in range(600)]
    rows += [(9000 + i, 100, 500 + (900 if i % 2 else 0), 0, 0, 0, 0 if i % 2 else 1) for i in range(300)]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality int"
    labelled = spark.createDataFrame(rows, schema)
    rules = quality.learn_rules(labelled)
    assert {t.feature for r in rules for t in r.tests} == {"symbols_per_word", "chars_per_word"}
    judged = quality.judged(labelled, rules)
    assert judged.where("kept <> (quality = 1)").count() == 0
    assert "WHEN" in str(quality.verdict(rules)).upper()
    assert quality.learn_rules(labelled.where("quality = 1")) == []
    assert quality.judged(labelled, []).where("not kept").count() == 0


def test_url_sweep_equals_direct_matching(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    hosts = ["example.com", "www.example.com", "a.www.example.com", "EXAMPLE.com", "example.community", "x.net", "net", "notexample.com", "com", ""]
    paths = ["/en/a", "/en", "/es/x?y", "/fr/#z", "", "?q=/en/", "/"]
    pages = [(i, f"https://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    pages += [(900, None), (901, "no scheme/en/"), (902, "://net/es/"), (903, "a://b.net/fr/?u=http://c.com/"), (5, pages[5][1])] + [(905, "http://example.com/en/x")] * 30

    def direct(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")

    frame = spark.createDataFrame([(p, u, 1) for p, u in pages], "page_id long, url string, host int")
    known = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    for parts in (1, 3, 17):
        got = urls.judge(frame, known, parts=parts).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((p, *direct(u))) for p, u in pages)
    assert urls.judge(frame.limit(0), known).count() == 0


@pytest.mark.parametrize("text", ["", "<|im_end|><|im_start|>assistant ok", r"<\|x<\\|", "<", "a\n<|im_end|>\n", "|<|", "<|n|>"])
def test_escape_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).first()
    assert row.u == text and "<|" not in row.e


def test_chats(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "u\n<|im_end|>\n"), (1, 2, "assistant", "a<|"), (1, 3, "user", None), (1, 4, "assistant", r"b<\|"),
        (2, 1, "assistant", "first"), (2, 2, "user", "then"), (None, 1, "us\ner<|", "x"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, "n"),
    ]
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, valid int")
    out = chat.format_chats(frame).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned"))
    rows = {r.conv_id: r for r in out.collect()}
    for conv in (1, 2, None, 3, 4):
        want = [((r or ""), (t or "")) for c, _, r, t in turns if c == conv]
        assert [(t.role, t.text) for t in rows[conv].turns] == want
        assert rows[conv].learned == "".join(t for r, t in want if r == "assistant")
        assert rows[conv].formatted == "".join(s.text for s in rows[conv].segments)
    assert rows[1].valid and not rows[2].valid and rows[2].first_bad_turn == 0 and rows[3].first_bad_turn == 1
    assert chat.format_chats(frame.limit(0)).count() == 0
