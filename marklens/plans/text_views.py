"""Token, sentence, match and edit views over ``documents``, with the same arithmetic as SQL text.

Part-of-speech, dependency and head columns stand in for an external parser, the match table for an
external checker; both are formulas of the document's own tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.functions import text as X
from marklens.operators import features as T
from marklens.plans.views import texts

_POS = "'NOUN', 'VERB', 'DET', 'ADJ', 'ADV', 'PROPN', 'AUX', 'PRON', 'ADP', 'NOUN'"
_DEP = "'nsubj', 'conj', 'advcl', 'ccomp', 'dobj', 'relcl', 'amod', 'xcomp'"
_HEAD = "CASE WHEN sent_pos = 0 THEN tok_i ELSE tok_i - 1 - CAST((doc_id + tok_i) % {half} AS INT) END"
_VOWELLESS = "^[^aeiouyAEIOUYàâäáéèêëíìîïóòôöúùûüÉÈÊÁÍÓÚÄÖÜñÑçÇß]+$"
_RULE = (
    "CASE WHEN is_alpha AND sent_pos > 0 AND {upper} THEN 'CASE' WHEN is_alpha AND sent_pos = 0 AND NOT {upper} THEN 'LOWER_START' "
    "WHEN is_alpha AND length(text) >= 12 THEN 'LONG_WORD' WHEN is_alpha AND length(text) >= 2 AND {bare} THEN 'NO_VOWEL' "
    "WHEN text IN ('|', '#', '*') THEN 'SYMBOL' END"
)
_TYPE = "CASE WHEN rule_id IN ('CASE', 'LOWER_START') THEN 'grammar' WHEN rule_id = 'SYMBOL' THEN 'style' ELSE 'misspelling' END"
_EDIT = (
    "CASE rule_id WHEN 'NO_VOWEL' THEN 'R:SPELL' WHEN 'LONG_WORD' THEN 'R:NOUN' WHEN 'CASE' THEN 'R:ORTH' "
    "WHEN 'LOWER_START' THEN 'R:VERB:SVA' ELSE 'M:PUNCT' END"
)

_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
TEXT_CTES = {
    "sn0": f"SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1)-1 AS sent_id FROM (SELECT doc_id, regexp_extract_all({_CLEAN}, '{X.SENTENCE_PATTERN}') AS x FROM documents)",
    "sn": "SELECT doc_id, CAST(sent_id AS INT) AS sent_id, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, piece FROM sn0",
    "tk0": f"SELECT doc_id, sent_id, unnest(x) AS piece, generate_subscripts(x, 1)-1 AS sent_pos FROM (SELECT doc_id, sent_id, regexp_extract_all(piece, '{X.TOKEN_PATTERN}') AS x FROM sn0)",
    "tk1": "SELECT doc_id, CAST(sent_id AS INT) AS sent_id, CAST(sent_pos AS INT) AS sent_pos, CAST(row_number() OVER w - 1 AS INT) AS tok_i, rtrim(piece) AS text, CAST(sum(length(piece)) OVER w - length(piece) AS BIGINT) AS char_start, "
    "regexp_matches(rtrim(piece), '^\\p{L}+$') AS is_alpha FROM tk0 WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id, sent_pos)",
    "tk": f"SELECT *, replace(lower(text), 'ß', 'ss') AS lemma, CASE WHEN is_alpha THEN [{_POS}][CAST((doc_id*7+tok_i*3) % 10 AS INT)+1] ELSE 'PUNCT' END AS pos, "
    f"CASE WHEN sent_pos=0 THEN 'ROOT' ELSE [{_DEP}][CAST((doc_id+tok_i*5) % 8 AS INT)+1] END AS dep, {_HEAD.format(half='((sent_pos + 1) // 2)')} AS head_i, char_start+length(text) AS char_end FROM tk1",
    "mt": f"SELECT doc_id, sent_id, {_TYPE} AS issue_type, rule_id, char_start AS \"offset\", CAST(length(text) AS INT) AS error_length FROM (SELECT *, "
    + _RULE.format(upper="regexp_matches(text, '^\\p{Lu}')", bare=f"regexp_matches(text, '{_VOWELLESS}')")
    + " AS rule_id FROM tk) AS r WHERE rule_id IS NOT NULL",
    "ed": f"SELECT doc_id, sent_id, {_EDIT} AS edit_type FROM mt",
}
_ORDER = list(TEXT_CTES)


def with_text(upto: str, body: str) -> str:
    """``WITH`` the text views up to the named ones, then ``body``."""
    last = max(_ORDER.index(n) for n in upto.split())
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{TEXT_CTES[n]})" for n in _ORDER[: last + 1])
    body = body.strip()
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = T.token_table(texts(spark, sf))
    return t.withColumns(
        {
            "lemma": X.fold_word(F.col("text")),
            "pos": F.expr(f"CASE WHEN is_alpha THEN element_at(array({_POS}), CAST((doc_id*7+tok_i*3) % 10 AS INT)+1) ELSE 'PUNCT' END"),
            "dep": F.expr(f"CASE WHEN sent_pos=0 THEN 'ROOT' ELSE element_at(array({_DEP}), CAST((doc_id+tok_i*5) % 8 AS INT)+1) END"),
            "head_i": F.expr(_HEAD.format(half="greatest(1, (sent_pos + 1) div 2)")),
        }
    )


def _of(formula: str) -> str:
    """A formula over columns as one over the token ``t`` of a list."""
    return re.sub(r"\b(is_alpha|tok_i|sent_pos|text)\b", r"t.\1", formula)


_PARSED = {
    "lemma": "replace(lower(text), 'ß', 'ss')",
    "pos": f"CASE WHEN is_alpha THEN element_at(array({_POS}), CAST((doc_id*7+tok_i*3) % 10 AS INT)+1) ELSE 'PUNCT' END",
    "dep": f"CASE WHEN sent_pos=0 THEN 'ROOT' ELSE element_at(array({_DEP}), CAST((doc_id+tok_i*5) % 8 AS INT)+1) END",
    "head_i": _HEAD.format(half="greatest(1, (sent_pos + 1) div 2)"),
}


def lists(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """One row per document with its cleaned text and the named fields of its tokens, also those of a parser; no shuffle."""
    parsed = [f for f in fields if f in _PARSED]
    if not parsed:
        return T.token_lists(texts(spark, sf), fields=fields)
    own = [f for f in T.TOKEN_FIELDS if f in fields or f in ("sent_pos", "tok_i", "text", "is_alpha")]
    out = T.token_lists(texts(spark, sf), fields=own)
    some = ", ".join([f"'{f}', {_of(_PARSED[f]) if f in _PARSED else f't.{f}'}" for f in fields])
    return out.withColumn("tokens", F.expr(f"transform(tokens, t -> named_struct({some}))"))


def with_matches(lists: DataFrame, placed: bool = False, sentence: bool = False) -> DataFrame:
    """Adds the list of matches of the tokens: with their offsets in the cleaned text if ``placed``, their sentences if asked."""
    rule = _of(_RULE.format(upper="text rlike '^\\\\p{Lu}'", bare=f"text rlike '{_VOWELLESS}'"))
    token, at = ("(t, i)", "_at[i]") if placed else ("t", "CAST(NULL AS BIGINT)")
    if placed:
        lists = lists.withColumn("_at", X.starts(F.col("tokens.piece_length")))
    match = f"named_struct('sent_id', {'t.sent_id' if sentence else 'CAST(NULL AS INT)'}, 'rule_id', {rule}, 'offset', {at}, 'error_length', length(t.text))"
    out = lists.withColumn("matches", F.expr(f"filter(transform(tokens, {token} -> {match}), m -> m.rule_id IS NOT NULL)"))
    out = out.drop("_at")
    kind = re.sub(r"\brule_id\b", "m.rule_id", _TYPE)
    return out.withColumn("matches", F.expr(f"transform(matches, m -> named_struct('sent_id', m.sent_id, 'issue_type', {kind}, 'rule_id', m.rule_id, 'offset', m.offset, 'error_length', m.error_length))"))


def with_edits(lists: DataFrame) -> DataFrame:
    """Adds the list of edits, one per match."""
    kind = re.sub(r"\brule_id\b", "m.rule_id", _EDIT)
    return with_matches(lists, sentence=True).withColumn("edits", F.expr(f"transform(matches, m -> named_struct('sent_id', m.sent_id, 'edit_type', {kind}))"))


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return T.sentence_table(texts(spark, sf))


def matches_of(tokens: DataFrame) -> DataFrame:
    rule = F.expr(_RULE.format(upper="text rlike '^\\\\p{Lu}'", bare=f"text rlike '{_VOWELLESS}'"))
    m = T.token_offsets(tokens).withColumn("rule_id", rule).where(F.col("rule_id").isNotNull())
    return m.select(
        "doc_id", "sent_id", F.expr(_TYPE).alias("issue_type"), "rule_id", F.col("char_start").alias("offset"), F.length("text").alias("error_length")
    )


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return matches_of(tokens(spark, sf))


def edits(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).select("doc_id", "sent_id", F.expr(_EDIT).alias("edit_type"))
