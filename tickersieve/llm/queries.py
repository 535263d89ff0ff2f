"""The corpus queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickersieve.llm import audit, decontaminate, fingerprint, frames, html, jaccard, langid, lines, packing, pii, quality, shards, substring, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = frames.new_path(spark, "shards")
    shards.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2, folder)
    return shards.read_digests(spark, folder)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 0, 2048)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many were removed, and the sha256 of what is left."""
    done = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: contaminated or not, by how many items, the best item and its score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decontaminate.scored(docs, table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", "score")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.divergences(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.drop("stratum", "n_lines", "rejected_by")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_fingerprints": op3_fingerprints,
    "op4_token_shards": op4_token_shards,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_html_extraction": op9_html_extraction,
    "op10_pii": op10_pii,
    "op11_source_divergence": op11_source_divergence,
    "op12_quality_rules": op12_quality_rules,
    "op13_spelling_variants": op13_spelling_variants,
}
# These have results that SQL can state in full; the others are tested in tests/llm.
_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"


def _rest(byte: int) -> int:
    """The remainder of the public CRC-32 for a byte, from its polynomial."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


# The unsigned crc32 of a text, byte by byte.
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode({0}))), lambda i: cast('0x' || substr(hex(encode({0})), 2 * i + 1, 2) as bigint))), "
    f"lambda state, byte: xor({[_rest(b) for b in range(256)]}[(xor(state, byte) & 255) + 1], state >> 8)), 4294967295)"
)


def _cutoffs() -> str:
    return ", ".join(f"({r}, {k}, {c})" for r, (_, _, cutoffs, _) in enumerate(quality.RULES.values()) for k, c in enumerate(cutoffs, 1))


def _rule_sql(number: int) -> str:
    count, by, _, below = list(quality.RULES.values())[number]
    return f"{count} * {quality.SCALE} {'<' if below else '>'} cutoff * {by or 1}"


ORACLE: dict[str, str] = {
    "op1_substring_dedup": f"""
with texts as (select doc_id, {_WORDS.format("text")} as words from documents),
windows as (
  select doc_id, i, array_to_string(words[i:i + 49], ' ') as run
  from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from texts where len(words) >= 50)),
firsts as (select run, min(doc_id) as low from windows group by run),
gone as (
  select distinct w.doc_id, unnest(range(w.i, w.i + 50)) as k
  from windows w join firsts f on f.run = w.run where f.low < w.doc_id),
places as (select doc_id, unnest(range(1, len(words) + 1)) as k, unnest(words) as word from texts),
kept as (
  select p.doc_id, string_agg(p.word, ' ' order by p.k) as left_over
  from places p anti join gone g on g.doc_id = p.doc_id and g.k = p.k group by p.doc_id),
removed as (select doc_id, count(*) as n from gone group by doc_id)
select t.doc_id, cast(len(t.words) as bigint) as n_words, cast(coalesce(r.n, 0) as bigint) as n_removed,
       sha256(coalesce(k.left_over, '')) as kept_sha256
from texts t left join kept k on k.doc_id = t.doc_id left join removed r on r.doc_id = t.doc_id""",
    "op2_jaccard_join": f"""
with recursive texts as (
  select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as words
  from documents),
sets as (
  select distinct doc_id, unnest(case
    when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingle from texts),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from sets a join sets b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * common >= 80 * (x.n + y.n - common)),
steps as (select a, b from links union all select b, a from links),
reached as (
  select doc_id as a, doc_id as b from texts
  union select r.a, s.b from reached r join steps s on s.a = r.b)
select t.doc_id, cast(coalesce(max(s.n), 0) as bigint) as n_shingles, min(r.b) as component_id
from texts t left join sizes s on s.doc_id = t.doc_id join reached r on r.a = t.doc_id group by t.doc_id""",
    "op11_source_divergence": r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
found as (
  select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as n from found group by lang, term having count(distinct id) >= 10),
langs as (select lang, count(*) as v, sum(n) as total from kept group by lang),
groups as (select distinct lang, source from docs),
own as (select lang, source, term, count(*) as n from found semi join kept using (lang, term) group by lang, source, term),
totals as (select lang, source, sum(n) as total from own group by lang, source),
shares as (
  select g.lang, g.source, k.term, coalesce(o.n, 0) as n,
         1 + (cast(1000000000 as hugeint) * (coalesce(o.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) as p,
         1 + (cast(1000000000 as hugeint) * (k.n + 2)) // (l.total + 2 * l.v) as q
  from groups g join kept k on k.lang = g.lang join langs l on l.lang = g.lang
  left join totals t on t.lang = g.lang and t.source = g.source
  left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from shares where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranked where part = 'pair' or rank <= 10""",
    "op12_quality_rules": f"""
with texts as (
  select row_number() over () as id, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text, {_WORDS.format("text")} as words from documents),
windows as (
  select id, i, array_to_string(words[i:i + 7], ' ') as run
  from (select id, words, unnest(range(1, len(words) - 6)) as i from texts where len(words) >= 8)),
twice as (select id, run from windows group by id, run having count(*) > 1),
repeated as (
  select id, count(distinct k) as n from (select w.id, unnest(range(w.i, w.i + 8)) as k from windows w semi join twice using (id, run)) group by id),
lines as (
  select id, count(*) as n, count(*) - count(distinct line) as again
  from (select id, unnest(string_split(text, chr(10))) as line from texts) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by id),
counts as (
  select t.id, doc_id, stratum, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(l.again, 0) as n_dup_lines,
    coalesce(r.n, 0) as n_repeat_words, coalesce(l.n, 0) as n_lines
  from texts t left join lines l on l.id = t.id left join repeated r on r.id = t.id),
based as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts),
cutoffs as (select * from (values {_cutoffs()}) as c(rule, k, cutoff)),
fired as (
  select b.id, c.rule, c.k from based b, cutoffs c where not base_failed and case c.rule
    {" ".join(f"when {r} then {_rule_sql(r)}" for r in range(len(quality.RULES)))} end),
marks as (select doc_id, min(quality) > 0 as good from labels where doc_id is not null and quality is not null group by doc_id),
known as (select b.id, b.stratum, m.good, {_CRC32.format("cast(b.doc_id as varchar)")} % 2 as half from based b join marks m on m.doc_id = b.doc_id where not base_failed),
totals as (select stratum, count(*) filter (good) as good_all, count(*) filter (not good) as bad_all from known where half = 0 group by stratum),
offered as (
  select k.stratum, f.rule, f.k, count(*) filter (good) as good, count(*) filter (not good) as bad, any_value(good_all) as good_all, any_value(bad_all) as bad_all
  from known k join fired f on f.id = k.id join totals t on t.stratum = k.stratum where half = 0 group by k.stratum, f.rule, f.k),
steps as (
  select stratum, rule, k, row_number() over (partition by stratum order by good, bad desc, rule, k) as step
  from offered where bad > 0 and bad * good_all >= {quality.LIFT} * good * bad_all),
firsts as (select b.id, min(s.step) as step from based b join fired f on f.id = b.id join steps s on s.stratum = b.stratum and s.rule = f.rule and s.k = f.k group by b.id),
holdout as (select k.stratum, f.step from known k semi join totals t on t.stratum = k.stratum left join firsts f on f.id = k.id where half = 1 and good),
sizes as (select stratum, count(*) as n, count(*) over () as strata from holdout group by stratum),
tried as (
  select s.stratum, s.step, z.n, z.strata, (select count(*) from holdout h where h.stratum = s.stratum and h.step <= s.step) as k
  from steps s join sizes z on z.stratum = s.stratum),
passed as (
  select stratum, step, k <= n * {quality.RISK} and list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - (case when i = 0 then 0 else lgamma(i + 1) end) - (case when i = n then 0 else lgamma(n - i + 1) end)
        + i * ln({quality.RISK}) + (n - i) * ln(1 - {quality.RISK})))) <= cast({quality.LEVEL} as double) / strata as ok from tried),
chosen as (
  select stratum, coalesce(min(step) filter (not ok) - 1, max(step)) as last from passed group by stratum)
select b.doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and not coalesce(f.step <= c.last, false) as kept
from based b left join firsts f on f.id = b.id left join chosen c on c.stratum = b.stratum""",
    "op13_spelling_variants": f"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00c0-\u00ff]+')) as run from documents),
each as (select doc_id, run, count(*) as n from runs group by doc_id, run),
hashed as (select run, n, {_CRC32.format("coalesce(cast(doc_id as varchar), '') || ':' || run")} as h from each),
thinned as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from thinned where length(word) >= 5 group by word having sum(n) >= 3),
less as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, w.word from less a join words w on w.word = a.rest
  union select w.word, a.word from less a join words w on w.word = a.rest),
best as (
  select e.word, e.other, o.n, count(*) over (partition by e.word) as n_near, row_number() over (partition by e.word order by o.n desc, e.other) as rank
  from near e join words o on o.word = e.other),
forms as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.n >= 2 * w.n then b.other end as form, case when b.n >= 2 * w.n then b.n end as form_n
  from words w left join best b on b.word = w.word and b.rank = 1),
ways as (
  select word, word as at from forms
  union all select w.word, f.form from ways w join forms f on f.word = w.at where f.form is not null)
select f.word, f.form, w.at as root, f.n, cast(f.n_near as bigint) as n_near, f.form_n
from forms f join ways w on w.word = f.word join forms e on e.word = w.at where e.form is null""",
}
