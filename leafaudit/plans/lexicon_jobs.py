"""Jobs on the pronunciation lexicon and word runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafaudit.operators import lexicon
from leafaudit.plans import derived as dv
from leafaudit.plans.registry import Inputs, job

KEYS = ["book", "doc_id"]


def _base(d) -> str:
    return f"""
    SELECT lower(trim(string_split(trim(line), chr(9))[1])) AS word,
           arg_max(trim(trim(string_split(string_split(trim(line), chr(9))[2], ',')[1]), '/'), seq) AS ipa
    FROM ({dv.lexicon_lines(d)}) l WHERE len(string_split(trim(line), chr(9))) = 2 GROUP BY 1"""


def table(inp: Inputs):
    rows = inp.keep(inp.derive(dv.latest_words), "latest-words")
    rows.createOrReplaceTempView("latest_words")
    view = lambda make: inp.derive(make, "SELECT * FROM latest_words")
    return lexicon.effective_lexicon(lexicon.lexicon_scan(view(dv.lexicon_lines)), view(dv.overrides))


@job(
    "lexicon_scan",
    lambda d: f"SELECT NULL AS book, word, ipa FROM ({_base(d)}) b UNION ALL SELECT book, word, ipa FROM ({dv.overrides(d)}) o",
)
def lexicon_scan(inp: Inputs):
    return table(inp)


def _tokens(d) -> str:
    flat = "translate(regexp_replace(text, '\\s+', ' ', 'g'), '’‘`', '''''''')"
    return f"""
    SELECT book, doc_id, i, t, regexp_matches(t, '^[a-zA-Z'']+$') AS is_word, NOT regexp_matches(t, '^[a-zA-Z''\\s]') AS is_punct
    FROM (SELECT book, doc_id, unnest(tk) AS t, generate_subscripts(tk, 1) AS i
          FROM (SELECT book, doc_id, regexp_extract_all({flat}, '[a-zA-Z'']+|\\s+|[^a-zA-Z''\\s]+') AS tk FROM ({dv.prose(d)}) e) a) b"""


def words_sql(d) -> str:
    return f"""
    WITH t AS (SELECT *, lag(t) OVER w AS p1, lag(is_punct) OVER w AS p1p, lag(is_word, 2) OVER w AS p2w, lead(t) OVER w AS n1, lead(is_punct) OVER w AS n1p,
                 lag(is_word) OVER w AS p1w, lead(is_word) OVER w AS n1w,
                 sum(CASE WHEN is_word THEN 1 ELSE 0 END) OVER w AS wn
               FROM ({_tokens(d)}) t WINDOW w AS (PARTITION BY book, doc_id ORDER BY i)),
    m AS (SELECT book, doc_id, wn, count(*) FILTER (WHERE NOT (is_punct AND (coalesce(p1w, false) OR coalesce(n1w, false)))) AS mid,
                 bool_or(is_punct AND NOT coalesce(p1w, false) AND NOT coalesce(n1w, false)) AS alone
          FROM t WHERE NOT is_word AND wn > 0 GROUP BY book, doc_id, wn),
    x AS (SELECT book, doc_id, wn, wn - 1 AS k, t AS word, CASE WHEN p1p AND NOT coalesce(p2w, false) THEN p1 ELSE '' END AS pre,
                 CASE WHEN n1p THEN n1 ELSE '' END AS post FROM t WHERE is_word),
    y AS (SELECT *, lead(pre) OVER (PARTITION BY book, doc_id ORDER BY k) AS next_pre FROM x)
    SELECT y.book, y.doc_id, CAST(k AS BIGINT) AS k, word, pre, post,
           CASE WHEN next_pre IS NOT NULL THEN coalesce(mid, 0) > 0 AND (post <> '' OR next_pre <> '' OR coalesce(alone, false)) END AS pause
    FROM y LEFT JOIN m ON m.book = y.book AND m.doc_id = y.doc_id AND m.wn = y.wn"""


@job("punct_attach", words_sql)
def punct_attach(inp: Inputs):
    return lexicon.words_with_punctuation(inp.derive(dv.prose), KEYS)


def looked_up_sql(d) -> str:
    return f"""
    SELECT w.*, coalesce(o.ipa, b.ipa) AS ipa FROM ({words_sql(d)}) w
    LEFT JOIN ({_base(d)}) b ON b.word = lower(w.word) LEFT JOIN ({dv.overrides(d)}) o ON o.word = lower(w.word) AND o.book = w.book"""


@job("lexicon_lookup", lambda d: f"SELECT book, doc_id, count(*) AS words, count(ipa) AS known FROM ({looked_up_sql(d)}) l GROUP BY book, doc_id")
def lexicon_lookup(inp: Inputs):
    return lexicon.word_coverage(inp.derive(dv.prose), inp.keep(table(inp), "lexicon"), KEYS, book="book")


@job(
    "liaison_link",
    lambda d: f"""
    WITH l AS (SELECT *, lead(ipa) OVER (PARTITION BY book, doc_id ORDER BY k) AS nx FROM ({looked_up_sql(d)}) l),
    t AS (SELECT *, CASE WHEN NOT coalesce(pause, true) AND regexp_matches(coalesce(nx, ''), '^[iuaeoy]') THEN ipa || '‿' ELSE ipa END AS tied FROM l)
    SELECT book, doc_id, k, pre || coalesce(regexp_replace(tied, '\\b(d|r|b)i', '\\1ɪ', 'g'), ' ') || post AS ipa_text FROM t""",
)
def liaison_link(inp: Inputs):
    entries = inp.keep(lexicon.pronunciations(table(inp)).drop("ipa"), "pronunciations")
    spoken = lexicon.annotated_runs(inp.derive(dv.prose), entries, KEYS, book="book")
    return lexicon.liaison_link(spoken, KEYS)
