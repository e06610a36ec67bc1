"""The queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.llm import ann, chat, decontamination, interactions, jaccard, langid, licenses, mixing, neardup, resampling, tokencount, tokens, toxicity
from lanternfish.llm.common import new_path, read

ORACLE: dict[str, str] = {}


def op1_decontamination(spark, sf_dir):
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE["op1_decontamination"] = r"""
with d as (
    select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
i as (
    select item_id::varchar as item_id, w, least(10, len(w)) as k from (
        select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark) where len(w) > 0),
windows as (
    select distinct item_id, k, array_to_string(w[p + 1 : p + k], ' ') as s from (select *, unnest(range(len(w) - k + 1)) as p from i)),
grams as (
    select r, k, p, array_to_string(w[p + 1 : p + k], ' ') as s
    from (select r, k, w, unnest(range(len(w) - k + 1)) as p from d, (select distinct k from windows) where len(w) >= k)),
hits as (select g.r, g.p, g.k, x.item_id from grams g join windows x on x.k = g.k and x.s = g.s),
spots as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + k)) as q from hits) group by r),
ids as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as s from hits group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join spots using (r) left join ids using (r)
"""


def op8_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return mixing.mixed(mixing.sized(docs)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op8_mixing"] = r"""
with sizes as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 15))::bigint as key from documents),
totals as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from sizes group by source),
weighed as (
    select *, [3, 1, 2][place % 3 + 1] as weight, 2 * source_size as cap from totals),
leveled as (
    select *, sum(cap) over (order by cap / weight, place rows unbounded preceding) as below,
           sum(weight) over () - sum(weight) over (order by cap / weight, place rows unbounded preceding) as above,
           (sum(source_size) over ())::double * 1.5 as total from weighed),
filled as (select *, (below + cap / weight * above)::double <= total as is_full from leveled),
targets as (
    select source, source_size, case when is_full then cap::double else
        (total - (sum(case when is_full then cap else 0 end) over ())::double) / (sum(case when is_full then 0 else weight end) over ())::double * weight end as target
    from filled),
placed as (
    select s.doc_id, s.size, t.source_size, t.target, floor(t.target)::bigint as budget,
           coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
    from sizes s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (case when source_size > 0 then budget // source_size else 0 end * size
        + greatest(0, least(size, budget - case when source_size > 0 then budget // source_size else 0 end * source_size - before)))::bigint as taken
from placed
"""


def op11_importance_resampling(spark, sf_dir):
    rows = resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE["op11_importance_resampling"] = r"""
with d as (
    select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (
    select regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
own as (select r, array_to_string(w[p : p + n - 1], ' ') as f from (select r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as p from d, range(1, 4) t(n))),
wanted as (select array_to_string(w[p : p + n - 1], ' ') as f from (select w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as p from b, range(1, 4) t(n))),
bits as (
    select f, list_concat([4294967295::bigint], flatten(list_transform(range(strlen(f)), lambda i: [('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint, 0, 0, 0, 0, 0, 0, 0]))) as l
    from (select distinct f from own union select f from wanted)),
hashed as (
    select f, xor(list_reduce(l, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 10000 as bucket from bits),
s as (select bucket, count(*) as n from own join hashed using (f) group by 1),
t as (select bucket, count(*) as n from wanted join hashed using (f) group by 1),
gains as (
    select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from own) + 10000)::double
                                   / ((s.n + 1)::double * ((select count(*) from wanted) + 10000)::double)))::bigint as gain
    from s left join t using (bucket)),
weights as (select r, count(*) as n_features, sum(gain)::bigint as weight from own join hashed using (f) join gains using (bucket) group by 1),
scored as (
    select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
           (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
    from d left join weights using (r)),
placed as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, 5 * count(*) over (partition by n_words >= 20) // 100 as most from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= most then place end as rank from placed
"""


def op12_filter_audit(spark, sf_dir):
    return interactions.audited(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = r"""
with texts as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
worded as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as first from texts),
marked as (
    select doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
                          regexp_matches(text, '[#$%&*|]'), doc_id > first] as fails from worded),
rows as (
    select part, fails, coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic from marked left join labels l using (doc_id)),
counted as (
    select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from rows group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
    select [ascii(a.x) - 64, ascii(b.x) - 64, ascii(c.x) - 64, ascii(d.x) - 64, ascii(e.x) - 64] as o, a.x || b.x || c.x || d.x || e.x as filter_order
    from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (
    select *, o[step] as f, fails[o[step]] as failing, coalesce(list_bool_or(list_transform(o[1 : step - 1], lambda k: fails[k])), false) as gone,
           len(list_filter(fails, lambda x: x)) as number
    from counted, orders, range(1, 6) t(step)),
found as (
    select part, filter_order, step, any_value(substr(filter_order, step::int, 1)) as letter, sum(case when not failing and not gone then n else 0 end)::bigint as kept,
           sum(case when failing and not gone then n else 0 end)::bigint as removed, sum(case when failing and gone then n else 0 end)::bigint as redundant,
           sum(case when failing and number = 1 then n else 0 end)::bigint as unique_fails, sum(case when failing and not gone then good else 0 end)::bigint as good_lost,
           sum(case when failing and not gone then toxic else 0 end)::bigint as toxic_lost
    from steps group by all)
select * exclude (letter) replace (step::int as step), (sum(removed) over (partition by part, letter))::bigint as shapley from found
"""


def op13_jaccard_join(spark, sf_dir):
    return jaccard.components(read(spark, sf_dir, "documents"))


ORACLE["op13_jaccard_join"] = r"""
with recursive texts as (select row_number() over () as r, doc_id, text from documents),
worded as (
    select r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from texts),
runs as (select distinct r, w[p : p + 3] as s from (select r, w, unnest(range(1, greatest(len(w) - 2, 2))) as p from worded where len(w) > 0)),
numbered as (select r, dense_rank() over (order by s) as s from runs),
sizes as (select r, count(*) as n from numbered group by r),
pairs as (select a.r as a, b.r as b, count(*) as same from numbered a join numbered b using (s) where a.r <> b.r group by 1, 2),
links as (select a, b from pairs join sizes x on x.r = a join sizes y on y.r = b where 100 * same >= 85 * (x.n + y.n - same)),
reached as (select r as a, r as b from texts union select reached.a, links.b from reached join links on reached.b = links.a)
select t.doc_id, coalesce(max(sizes.n), 0)::bigint as n_shingles, min(o.doc_id) as component_id
from texts t join reached on reached.a = t.r join texts o on o.r = reached.b left join sizes on sizes.r = t.r group by t.r, t.doc_id
"""


def op2_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return langid.fit(docs).identified(docs)


def op3_nearest_neighbours(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return ann.Forest(vectors).search(vectors.where("vec_id % 20 = 0"))


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    model = tokencount.Unigram.from_sentencepiece(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.counted(read(spark, sf_dir, "documents"), model)


def op5_chat_formatting(spark, sf_dir):
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = chat.read_back(chat.formatted(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE["op5_chat_formatting"] = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
seen as (
    select *, regexp_matches(role || chr(0) || text, '</?s>|\[/?INST\]|\\[^\x00]') or regexp_matches(text, '(?s)\\.') as conflict,
           len(regexp_extract_all(role || chr(0) || text, '\\|</?s>|\[/?INST\]')) as marks
    from turns),
placed as (
    select *, length(role) + length(text) + 20 + case when conflict then marks else 0 end as chars,
           row_number() over (partition by conv_id order by turn nulls last, role, text) as place from seen)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from placed group by conv_id
"""


#: Documents have no names: one that consists mostly of statements, headers or texts of licences stands for a licence file.
LICENSE_KINDS, LICENSE_SHARE = ("statement", "header", "text"), 0.5


def op6_license_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = licenses.scanned(docs.select(path.alias("path"), "text"), kinds=LICENSE_KINDS, mostly=LICENSE_SHARE)
    return rows.select(F.expr("try_cast(substring_index(path, '/', -1) as bigint)").alias("doc_id"), "own_license", "similarity", "license", "inherited_from")


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_QUOTED = lambda text: "'" + text.replace("'", "''") + "'"
_RE2 = lambda pattern: pattern.replace("(?md)", "(?m)").replace(")*+", ")*").replace("{2,}+", "{2,}").replace("'", "''")
ORACLE["op6_license_scan"] = f"""
with files as (
    select row_number() over () as r, doc_id, concat_ws('/', coalesce(source, ''), coalesce(lang, '')) as directory, text,
           regexp_replace(text, '{_RE2(licenses.MARKS)}', '', 'g') as bare from documents),
pieces as (
    select r, unnest(list_concat(list_concat(
        string_split_regex(regexp_replace(text, '([.!?])[ \\t]+(\\p{{Lu}})', '\\1' || chr(10) || '\\2', 'g'), '\\n'), string_split_regex(bare, '{licenses.PARAGRAPHS}')),
        list_transform(regexp_extract_all(text, '{_RE2(licenses.BLOCKS)}'), lambda b: regexp_replace(b, '{_RE2(licenses.MARKS)}', '', 'g')))) as piece
    from files where text is not null),
found as (select distinct r, array_to_string({_WORDS.format("piece")}, ' ') as unit from pieces),
templates as (select * from (values {", ".join(f"({i}, '{a}', '{b}', {_QUOTED(c)})" for i, (a, b, c) in enumerate(licenses.TEMPLATES))}) t(template, license, kind, text)),
total as (select count(*) as n from files where text is not null),
known as (select term, count(*) as n from (select unnest(list_distinct({_WORDS.format("text")})) as term from files) group by term),
theirs as (select template, term, count(*) as tf from (select template, unnest({_WORDS.format("text")}) as term from templates) group by all),
b as (select template, term, (1 + ln(tf)) * (ln((total.n + 1.0) / (coalesce(known.n, 0) + 1)) + 1) as w from theirs left join known using (term), total),
own as (select unit, term, count(*) as tf from (select unit, unnest(string_split(unit, ' ')) as term from (select distinct unit from found where unit <> '')) group by all),
a as (select unit, term, (1 + ln(tf)) * (ln((total.n + 1.0) / (known.n + 1)) + 1) as w from own join known using (term), total),
likes as (
    select unit, template, round(sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)), 6) as similarity
    from a join b using (term) join (select unit, sqrt(sum(w * w)) as norm from a group by 1) x using (unit)
    join (select template, sqrt(sum(w * w)) as norm from b group by 1) y using (template) group by all),
best as (
    select unit, arg_max(license, similarity * 1000 - template / 1000.0) as license, arg_max(kind, similarity * 1000 - template / 1000.0) as kind, max(similarity) as similarity
    from likes join templates using (template) where similarity >= {licenses.THRESHOLD} group by 1),
hits as (
    select r, license, kind, similarity, len(string_split(unit, ' ')) as stated from found join best using (unit)
    union all select r, regexp_replace(tag, '[ \\t]+', ' ', 'g'), 'tag', 1.0, 0 from (select r, regexp_extract(text, '{_RE2(licenses.TAG)}', 1) as tag from files) where tag <> ''),
mine as (select r, (max(struct_pack(t := kind = 'tag', s := similarity, l := license))).l as own_license, max(similarity) as similarity, sum(stated) as stated from hits group by 1),
granted as (
    select directory, (max(struct_pack(s := similarity, l := own_license))).l as granted from mine join files using (r)
    where stated > 0 and stated >= {LICENSE_SHARE} * len({_WORDS.format("text")}) group by 1),
up as (
    select f.directory, g.directory as ancestor, granted, row_number() over (partition by f.directory order by length(g.directory) desc) as place
    from (select distinct directory from files) f join granted g on f.directory = g.directory or starts_with(f.directory, g.directory || '/'))
select doc_id, own_license, similarity, coalesce(own_license, granted) as license, case when own_license is null then ancestor end as inherited_from
from files left join mine using (r) left join (select * from up where place = 1) using (directory)
"""


def op7_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.fit(docs, read(spark, sf_dir, "labels")).graded(docs)


def op9_minhash_neardup(spark, sf_dir):
    return neardup.classes(read(spark, sf_dir, "documents"))


def op10_token_output(spark, sf_dir):
    import public_tokenizers

    path = new_path(spark, "tokens")
    tokens.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    rows = tokens.with_starts(tokens.checksums(spark, path), spark, path)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
