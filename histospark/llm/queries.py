"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.llm import bpe, chat, embedding_dups, fingerprint, langid, licenses, minhash, mixing, quality, resampling, trie, urls, warc
from histospark.llm.common import WORD, held_out, n_words, small_batches, table

#: The tokenizer file that the queries use.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: A document of at least this score is predicted to be of label 1.
GOOD = 0.7


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.quality_score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = tokenizer_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.select("doc_id", bpe.bpe_round_trip(F.col("text"), path).alias("both")).select("doc_id", "both.*")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    near = fingerprint.with_next(docs, {"text": text, "fp": fingerprint.fingerprint(text)}, ranges)
    near = near.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    near = near.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fp", "next_fp", fingerprint.fingerprint(F.col("edited")).alias("edited_fp"))
    like = fingerprint.likeness
    return near.select("doc_id", "n_chars", "edited_sha256", fingerprint.as_text(F.col("fp")).alias("fingerprint"), fingerprint.as_text(F.col("edited_fp")).alias("edited_fingerprint"), like(F.col("fp"), F.col("edited_fp")).alias("near_edited"), like(F.col("fp"), F.col("next_fp")).alias("near_next"))


#: Both turns of the conversation that op4 adds: control strings inside a text.
TRICKY = "\\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    read = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), "formatted_chars", "valid")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return warc.archive_and_read(table(spark, sf_dir, "pages").select("page_id", "url", "html"), least_bytes=0).drop("payload")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.language(F.col("text"), model, spark).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.ambiguous").alias("ambiguous"))


def op8_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a folder for each source, in it one for each thousand ids, and in that one
    for each hundred, whose first document is its licence file; a null source is 'none', and documents
    without an id stand in no folder."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100), name))
    found = licenses.scan_licenses(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return found.withColumnRenamed("file_id", "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.systematic_mix(table(spark, sf_dir, "documents"), n_words(F.col("text")), salt=F.col("text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The listed rules of op11: host, start of the path, verdict.
LISTED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_urls(table(spark, sf_dir, "pages"), LISTED)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return trie.prefix_trie(trie.with_shared_heads(trie.conversation_rows(rows)))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_quality": op1_quality, "op2_bpe": op2_bpe, "op3_fingerprints": op3_fingerprints, "op4_chat": op4_chat, "op5_warc": op5_warc, "op6_minhash": op6_minhash, "op7_langid": op7_langid, "op8_embedding_dups": op8_embedding_dups, "op9_licenses": op9_licenses, "op10_mixing": op10_mixing, "op11_url_filter": op11_url_filter, "op12_conversation_trie": op12_conversation_trie, "op13_resampling": op13_resampling}


#: A hexadecimal digest of 160 bits in base32: five hexadecimal digits give four signs.
BASE32 = "list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((cast('0x' || sha[5 * g + 1 : 5 * g + 5] as bigint) >> s) & 31) + 1]), lambda x, y: x || y)), lambda x, y: x || y)"

#: Components of links(a, b) over nodes(id), as a recursive view comps(id, component).
COMPONENTS = """walk(id, label) as (select id, id from nodes union select l.b, w.label from walk w join (select a, b from links union all select b, a from links) l on l.a = w.id where w.label < l.b),
comps as (select id, min(label) as component from walk group by id)"""

#: The 256 remainders of the CRC-32 of one byte, and the CRC-32 of a text's UTF-8 bytes with them.
CRC_TABLE = "(select list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as rest)"
CRC = "xor(list_reduce(list_transform(range(0, octet_length(encode({0}))), lambda i: cast('0x' || substr(hex(encode({0})), 2 * i + 1, 2) as bigint)), lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"

SQL = {
    "op4_chat": r"""with raw as (select conv_id, turn, role, text from conversations union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from raw),
e as (select *, '### ' || case role when 'system' then 'System' when 'user' then 'User' when 'assistant' then 'Assistant' else '@' || regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') end || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' as piece from t)
select conv_id, cast(count(*) as bigint) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(length(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(length(string_agg(piece, chr(10) order by turn nulls first, role, text)) as bigint) as formatted_chars,
  regexp_full_match(string_agg(case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' else 'x' end, '' order by turn nulls first, role, text), 's?(ua)+') as valid
from e group by conv_id""",
    "op5_warc": f"""with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages), k as (select sha, max(page_id) as kept from p group by sha),
r as (select *, coalesce(page_id < kept, kept is not null) as again from p join k using (sha))
select page_id, cast(strlen(html) as bigint) as payload_bytes, {BASE32} as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then kept end as refers_to from r""",
    "op6_minhash": rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as words from documents),
s as (select distinct doc_id, array_to_string(words[i : i + 3], ' ') as shingle from (select doc_id, words, unnest(range(1, greatest(1, len(words) - 3) + 1)) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
nodes as (select doc_id as id from documents), {COMPONENTS}
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component as component_id, d.doc_id = component as kept from documents d left join n on n.doc_id = d.doc_id join comps c on c.id = d.doc_id""",
    "op8_embedding_dups": f"""with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id < b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
nodes as (select vec_id as id from embeddings), {COMPONENTS},
deg as (select id, count(*) as n from (select a as id from links union all select b from links) group by id)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component as component_id, vec_id = component as kept from embeddings e join comps c on c.id = e.vec_id left join deg on deg.id = e.vec_id""",
    "op10_mixing": "select doc_id, size, source_size, target, copies * size as taken from (" + mixing.MIX_SQL.format(docs="documents") + ")",
    "op12_conversation_trie": f"""with t as (select conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as key, cast(octet_length(encode(coalesce(text, ''))) as bigint) as bytes, turn from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, key) as place from t),
c as (select conv_id, conv_id - conv_id % 5 as family, {CRC.format("cast(conv_id as varchar)")} % 9 as h from (select distinct conv_id from t), {CRC_TABLE}),
r as (select c.conv_id, place, key, bytes from c join o on o.conv_id = c.family where place <= h union all select c.conv_id, place, key, bytes from c join o on o.conv_id = c.conv_id where place > h),
m as (select conv_id, row_number() over w as depth, bytes, string_agg(key, '') over w as path from r window w as (partition by conv_id order by place) union all select conv_id, 0, 0, '' from c),
n as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes from m group by path, depth),
e as (select path, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as ends_sha256 from (select conv_id, arg_max(path, depth) as path from m group by conv_id) group by path),
k as (select left(path, len(path) - 32) as up, count(*) as n_children from n where depth > 0 group by up),
a as (select left(n.path, 32 * d) as path, count(*) filter (up is null) as n_leaves, sum((n_convs - 1) * bytes) as saved from (select *, unnest(range(0, depth + 1)) as d from n) n left join k on k.up = n.path group by all)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from n left join k on k.up = n.path join a on a.path = n.path left join e on e.path = n.path left join n p on n.depth > 0 and p.path = left(n.path, len(n.path) - 32)""",
    "op13_resampling": rf"""with w as (select 'd' as kind, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words, row_number() over () as row from documents
  union all select 'b', item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []), row_number() over () from benchmark),
f as (select kind, row, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as feature from w),
k as (select feature, {CRC.format("feature")} % 10000 as bucket from (select distinct feature from f), {CRC_TABLE}),
c as (select kind, row, bucket, count(*) as n from f join k using (feature) group by all),
g as (select bucket, coalesce(sum(n) filter (kind = 'd'), 0) as s, coalesce(sum(n) filter (kind = 'b'), 0) as t from c group by bucket),
a as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from g),
v as (select bucket, cast(floor(1000 * ln(cast((t + 1) * (s_all + 10000) as double) / cast((s + 1) * (t_all + 10000) as double))) as bigint) as gain from g, a),
d as (select row, cast(sum(n) as bigint) as n_features, cast(sum(n * gain) as bigint) as total from c join v using (bucket) where kind = 'd' group by row),
x as (select doc_id, len(words) as n_words, coalesce(n_features, 0) as n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) as weight, cast('0x' || sha256('7:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) as h from w left join d using (row) where kind = 'd'),
y as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from x),
z as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, n_features) as place, count(*) filter (n_words >= 20) over () as fit from y)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * fit // 100 then place end as rank from z""",
}
