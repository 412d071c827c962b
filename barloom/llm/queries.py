"""The registered queries on texts, each a thin use of its operator on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    decontaminate, hard_negatives, html_text, langid, ngram_join, periodic, pieces, pruned_graph, quality, secrets,
    sharding, token_files, tool_chat,
)
from barloom.scratch import scratch_folder, stored

SHARDS = 40
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, by a stored slot map."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.record_size(F.col("text")).alias("size"),
        sharding.text_crc32(F.col("text")).alias("text_crc32"),
    )
    slotted = sharding.with_slots(docs, ("doc_id", "text_crc32"))
    loads = stored(sharding.slot_loads(slotted), "loads")
    path = scratch_folder(spark, "slot-map")
    sharding.write_map(sharding.edit_map(loads, SHARDS), path)
    placed = sharding.assign(slotted, loads, sharding.read_map(spark, path))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict."""
    docs = table(spark, sf_dir, "documents")
    words = secrets.dictionary(docs)
    trees = secrets.train(secrets.rule_labels(docs), words)
    return secrets.scan(docs, trees, words).select(
        "doc_id", F.posexplode("findings").alias("ordinal", "f")
    ).select(
        "doc_id",
        "ordinal",
        F.sha2("f.value", 256).alias("value_sha256"),
        F.length("f.value").cast("long").alias("n_chars"),
        "f.score",
        "f.is_secret",
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule counts and the verdict of rules and isolation forest."""
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    counts = [c for c in quality.COUNTS if c != "n_lines"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that benchmark windows cover, and the items hit."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    """Every document's ids and decoded text, as digests, and the bytes its pieces span."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, public_tokenizers.path(model), decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.element_at("ends", -1).cast("long").alias("n_bytes"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links of 90 % Jaccard on three-word shingles."""
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from four fifths of the documents."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.learn(docs.where("doc_id is not null and not held_out"))
    guessed = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return guessed.select("doc_id", "held_out", "lang_pred", "score")


#: The tools' arguments: name, key, kind, whether it must be there.
_TOOLS = """values ('search', 'limit', 'integer', true), ('search', 'query', 'string', true),
  ('translate', 'lang', 'string', true), ('translate', 'text', 'string', true),
  ('count', 'unit', 'string', true), ('count', 'text', 'string', true), ('count', 'words', 'integer', false)"""


def tool_calls(turns: DataFrame) -> DataFrame:
    """The assistant turns of ``conversations`` read as tool calls.

    The whole text is an argument. Tool, other arguments and dependencies follow from the
    turn and its text: some arguments lack a key, have one of another kind or one too many, and some calls depend on the
    assistant's next turn, so that order by turn is not enough.
    """
    quoted, n = F.expr("substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)"), F.length("text")
    step = F.floor(F.col("turn") / 2) % 4
    search = F.concat(
        F.lit('{ "query" : '), quoted, F.lit(', "limit": '),
        F.when(n % 5 == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n.cast("string")), F.lit(" }"),
    )
    translate = F.concat(
        F.lit('{"text":'), quoted, F.when(n % 7 == 0, F.lit("}")).otherwise(F.lit(', "lang":"en"}'))
    )
    count = F.concat(
        F.lit('{"words": '), n, F.when(n % 11 == 0, F.lit(', "more": [1, 2.50]')).otherwise(F.lit("")),
        F.lit(', "text": '), quoted, F.lit(', "unit": "word"}'),
    )

    def at(turn: F.Column) -> F.Column:
        return F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), turn)

    after, before, first = at(F.col("turn") + 2), at(F.col("turn") - 2), at(F.col("turn") - 6)
    kind = F.col("turn") % 3
    return turns.where("role = 'assistant'").select(
        "conv_id",
        "turn",
        at(F.col("turn")).alias("call_id"),
        F.when(kind == 0, "search").when(kind == 1, "translate").otherwise("count").alias("name"),
        F.when(kind == 0, search).when(kind == 1, translate).otherwise(count).alias("arguments"),
        F.when(step == 0, F.array(after)).when(step == 2, F.array(before, after))
        .when(step == 3, F.array(first)).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )


def tool_results(turns: DataFrame) -> DataFrame:
    """The user turns, each read as the result of a call in the turn before."""
    return turns.where("role = 'user'").select(
        "conv_id",
        "turn",
        F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.col("turn") - 1).alias("call_id"),
        F.col("text").alias("content"),
    )


def op8_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations: calls linked, ordered, checked; other turns beside them."""
    turns = table(spark, sf_dir, "conversations")
    schemas = spark.sql(_TOOLS).toDF("name", "key", "kind", "required")
    messages = turns.where("role is null or role not in ('assistant', 'user')")
    return tool_chat.format_chat(tool_calls(turns), tool_results(turns), messages, schemas)


def op9_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = BYTE_BPE) -> DataFrame:
    """All documents written as files of directly addressable codes and read back."""
    path = scratch_folder(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer), path)
    return token_files.read(spark, path, with_ids=False)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth one, in graphs over all of them."""
    rows = table(spark, sf_dir, "embeddings")
    shards = pruned_graph.index(rows, "vec_id", "embedding")
    found = pruned_graph.search(shards, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20)
    return found.withColumnRenamed("id", "vec_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with every seventh label moved on by one."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(finite).select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector"),
    )
    return hard_negatives.mine(rows, "vec_id", "label", "vector", F.col("vec_id") % 50 == 0)


def repeated_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where every tenth document by checksum repeats a stretch of itself.

    Such a text, given as its words, goes on from word ``a`` with copies of the ``p`` words there.
    """
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    rows = docs.select(
        "doc_id", "text", F.floor(checksum / 10).alias("g"), F.when(checksum % 10 == 0, words).alias("words")
    )
    numbered = rows.select("*", F.size("words").cast("long").alias("n"), F.expr("g % size(words)").alias("a")).where("n > 0")
    numbered = numbered.select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    copies = F.expr("flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a + p - 1) div p)))")
    again = F.array_join(F.concat(F.expr("slice(words, 1, int(a))"), F.slice(copies, F.lit(1), F.expr("int(n - a)"))), " ")
    rest = rows.where("coalesce(size(words), 0) <= 0").select("doc_id", "text")
    return rest.union(numbered.select("doc_id", again))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, its most repeated one, and its text without repeats, as digests."""
    found = periodic.with_runs(repeated_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = found.select("*", periodic.most_repeated(F.col("runs")).alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_sharding,
        op2_secret_scan,
        op3_quality_rules,
        op4_decontamination,
        op5_sentencepiece,
        op6_ngram_join,
        op7_language_id,
        op8_tool_chat,
        op9_token_files,
        op10_html_extraction,
        op11_nearest_vectors,
        op12_hard_negatives,
        op13_periodic_runs,
    ]
    return {query.__name__: query for query in named}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL_WORDS = (
    f"regexp_extract_all({_LOWER.format('text')}, "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_DECONTAMINATION = f"""
with item_words as (select item_id::varchar as item, {_NORMAL_WORDS} as words from benchmark),
windows as (
  select distinct item, list_slice(words, i, i + 9) as win
  from (select item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i
        from item_words where len(words) > 0)),
lengths as (select distinct len(win) as n from windows),
doc_words as (select doc_id, coalesce({_NORMAL_WORDS}, []) as words from documents),
stretches as (
  select doc_id, i, n, list_slice(words, i, i + n - 1) as win
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i
        from doc_words cross join lengths)),
hits as (select doc_id, i, n, item from stretches join windows using (win)),
hit_words as (
  select doc_id, count(distinct place) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as place from hits) group by 1),
hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item from hits) group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hit_words using (doc_id) left join hit_items using (doc_id)"""


_NGRAM_JOIN = f"""
with recursive doc_words as (
  select doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) as words
  from documents),
shingles as (
  select distinct doc_id, array_to_string(list_slice(words, i, i + 2), ' ') as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) as i
        from doc_words where len(words) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
links as (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b using (shingle)
  join sizes m on a.doc_id = m.doc_id join sizes n on b.doc_id = n.doc_id
  where a.doc_id <> b.doc_id and 100 * least(m.n, n.n) >= 90 * greatest(m.n, n.n)
  group by a.doc_id, b.doc_id, m.n, n.n
  having 100 * count(*) >= 90 * (m.n + n.n - count(*))),
reached as (
  select doc_id as node, doc_id as root from documents
  union
  select links.b, reached.root from reached join links on links.a = reached.node)
select node as doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(root) as component_id
from reached left join sizes on sizes.doc_id = node group by node"""


_TOOL_CHAT = """
with recursive turns as (
  select conv_id, turn, role, text, length(text) as n, to_json(text)::varchar as quoted, (turn // 2) % 4 as step
  from conversations),
calls as (
  select conv_id, turn, 'call-' || conv_id || '-' || turn as call_id, n, quoted,
         ['search', 'translate', 'count'][1 + turn % 3] as name,
         case step when 0 then [turn + 2] when 2 then [turn - 2, turn + 2] when 3 then [turn - 6]
              else [] end as needs
  from turns where role = 'assistant'),
results as (
  select conv_id, turn - 1 as turn, min_by(text, turn) as result from turns where role = 'user' group by 1, 2),
needed as (
  select c.conv_id, c.turn, d.turn as needs
  from (select conv_id, turn, unnest(needs) as need from calls) c
  join calls d on c.conv_id = d.conv_id and c.need = d.turn),
deep as (
  select conv_id, turn, 0 as level from calls
  union
  select needed.conv_id, needed.turn, deep.level + 1
  from deep join needed on deep.conv_id = needed.conv_id and deep.turn = needed.needs
  where deep.level < 10),
levels as (select conv_id, turn, max(level) as level from deep group by 1, 2),
judged as (
  select calls.*, level, result,
         case name when 'search' then case when n % 5 = 0 then 'kind:limit' else '' end
                   when 'translate' then case when n % 7 = 0 then 'missing:lang' else '' end
                   else case when n % 11 = 0 then 'unknown:more' else '' end end as errors,
         case name
           when 'search' then
             case when n % 5 = 0 then '{ "query" : ' || quoted || ', "limit": "' || n || '" }'
                  else '{"limit":' || n || ',"query":' || quoted || '}' end
           when 'translate' then
             case when n % 7 = 0 then '{"text":' || quoted || '}'
                  else '{"lang":"en","text":' || quoted || '}' end
           else
             case when n % 11 = 0 then '{"words": ' || n || ', "more": [1, 2.50], "text": ' || quoted || ', "unit": "word"}'
                  else '{"text":' || quoted || ',"unit":"word","words":' || n || '}' end end as arguments
  from calls join levels using (conv_id, turn) left join results using (conv_id, turn)),
rows as (
  select conv_id, level as place, turn, call_id, name, level::integer as level,
         case when result is null then 'pending' else 'linked' end as status, errors,
         '{"arguments":' || case when errors = '' then arguments else to_json(arguments)::varchar end
         || ',"id":"' || call_id || '","name":"' || name || '"'
         || case when result is null then '' else ',"result":' || to_json(result)::varchar end
         || ',"type":"function"}' as json
  from judged
  union all
  select conv_id, 1000000, turn, 'call-' || conv_id || '-' || (turn - 1), null, -1, 'orphan', '',
         '{"content":' || quoted || ',"id":"call-' || conv_id || '-' || (turn - 1) || '","type":"result"}'
  from turns where role = 'user' and (conv_id, turn - 1) not in (select (conv_id, turn) from calls)
  union all
  select conv_id, -1, turn, null, null, -1, 'message', '',
         '{"content":' || quoted || ',"role":"' || role || '","type":"message"}'
  from turns where role not in ('user', 'assistant'))
select conv_id, row_number() over (partition by conv_id order by place, turn) - 1 as position,
       turn, call_id, name, level, status, errors = '' as valid, errors, json
from rows"""


_HARD_NEGATIVES = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id as id, r.label = a.label as is_same,
         list_inner_product(a.v, r.v)::bigint as score
  from rows a join rows r on len(a.v) = len(r.v) and a.vec_id <> r.vec_id where a.vec_id % 50 = 0),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where is_same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id,
       (row_number() over (partition by anchor_id, positive_id order by score desc, id))::integer as rank,
       id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not is_same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": _DECONTAMINATION,
        "op6_ngram_join": _NGRAM_JOIN,
        "op8_tool_chat": _TOOL_CHAT,
        "op12_hard_negatives": _HARD_NEGATIVES,
    }
