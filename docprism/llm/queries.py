"""The registered queries of this package and their SQL."""

from __future__ import annotations

from docprism.llm import align, chat, decontaminate, jaccard, kneser, licences, lines, packing, periodic, quality, sql, suffixes, toxicity, urls
from docprism.llm.store import table


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard.classes(table(spark, sf_dir, "documents"), words=3, percent=90)  # the contract's


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.evaluate(urls.with_days(pages), urls.dated_entries(pages))


def op5_line_dedup(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark, sf_dir):
    return suffixes.report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_licence_scans(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark, sf_dir):
    r"""All conversations (row layout) and one of two turns that say control strings (message layout)."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.sql("select -7L as conv_id, array(named_struct('role', 'user', 'content', :said), named_struct('role', 'assistant', 'content', :said)) as messages", args={"said": said})
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(extra))
    return chat.digest(chat.format_turns(turns))


def op11_periodic_runs(spark, sf_dir):
    return periodic.report(table(spark, sf_dir, "documents"))


def op12_lm_scoring(spark, sf_dir):
    return kneser.report(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark, sf_dir):
    return align.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_best_fit_packing,
        op3_benchmark_decontamination,
        op4_url_filters,
        op5_line_dedup,
        op6_suffix_array_dedup,
        op7_toxicity,
        op8_quality_rules,
        op9_licence_scans,
        op10_chat_formatting,
        op11_periodic_runs,
        op12_lm_scoring,
        op13_tokenizer_alignment,
    )
}

#: The others are no SQL (a tokenizer, trained models) or too slow there (byte windows of whole texts); tests hold them against brute force.
SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": sql.JACCARD,
    "op3_benchmark_decontamination": sql.DECONTAMINATE,
    "op4_url_filters": urls.SQL,
    "op5_line_dedup": sql.LINES,
    "op8_quality_rules": sql.QUALITY,
    "op10_chat_formatting": chat.SQL,
}
