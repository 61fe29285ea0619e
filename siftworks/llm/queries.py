"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftworks.llm import bpe, chat, collisions, mixing, multiset, phrases, quality_rank, repetition, secret_scan, simhash, vector_codes, warc, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.quality_rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_coverage(_read(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.chat_digests(rows.unionByName(planted))


def op6_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited_likeness(_read(spark, sf_dir, "documents"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents"), secret_scan.train(_read(spark, sf_dir, "documents")))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).drop("times")


def op10_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeated_phrases(_read(spark, sf_dir, "documents")).drop("kept_text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_read(spark, sf_dir, "embeddings"))


def op12_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.nearest_vectors(_read(spark, sf_dir, "embeddings"))


def op13_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(_read(spark, sf_dir, "embeddings"))


#: Rows by turn; the template of chat.py spelled out.
OP5_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
    length(replace(replace(replace(replace(replace(text, '\', '\0'), '<s>', '\1'), '[INST]', '\2'), '[/INST]', '\3'), '</s>', '\4')) as text_chars,
    length(replace(replace(replace(replace(replace(role, '\', '\0'), '<s>', '\1'), '[INST]', '\2'), '[/INST]', '\3'), '</s>', '\4')) as role_chars
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(text_chars + case when before is null or before <> role then role_chars + length('<s>[INST]</s>') else length('[/INST]') end) as bigint) as formatted_chars
from marked group by conv_id
"""

#: Largest page of equal payloads is the response; the digest's 40 hex digits become 32 base32 digits, five to four.
OP2_SQL = r"""
with rows as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes from pages
), tops as (
  select html, max(page_id) as top from rows group by html
), marked as (
  select r.*, sha1(r.html) as sha, case when r.page_id is distinct from t.top and t.top is not null then t.top end as refers_to
  from rows r join tops t on r.html = t.html
)
select page_id, payload_bytes, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (('0x' || substr(sha, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - i % 4 * 5)::int)::int % 32 + 1, 1)), '') as payload_digest,
  trim(regexp_replace(url, '[\s]+', ' ', 'g')) as url,
  case when refers_to is null then greatest((payload_bytes + 1048575) // 1048576, 1) else 1 end as n_chunks, true as valid
from marked
"""

#: Every window as an array of words, with the smallest document that it starts in.
OP10_SQL = r"""
with texts as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents
), windows as (
  select r, doc_id, i, md5(array_to_string(list_slice(words, i, i + 12), ' ')) as w
  from (select r, doc_id, words, unnest(range(1, len(words) - 11)) as i from texts)
), judged as (
  select r, i, doc_id > min(doc_id) over (partition by w) as again from windows
), gone as (
  select distinct r, unnest(range(i, i + 13)) as pos from judged where again
), placed as (
  select r, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from texts
), kept as (
  select p.r, count(g.pos) as n_removed, string_agg(case when g.pos is null then p.word end, ' ' order by p.pos) as kept
  from placed p left join gone g on g.r = p.r and g.pos = p.pos group by p.r
)
select t.doc_id, len(t.words)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from texts t left join kept k on t.r = k.r
"""


def op4_sql() -> str:
    """Base rules and coverage of each n-gram length, by grouping whole n-grams and lines."""
    sizes = sorted({*repetition.LIMITS, repetition.BASE_WINDOW})
    limits = " and ".join(f"100 * dup_{n}gram_chars <= {share} * word_chars" for n, share in repetition.LIMITS.items())
    chars = ", ".join(f"coalesce(sum(chars) filter (n = {n}), 0)::bigint as dup_{n}gram_chars" for n in repetition.LIMITS)
    windows = " union all ".join(
        f"select r, {n} as n, i, md5(array_to_string(list_slice(words, i, i + {n - 1}), ' ')) as w "
        f"from (select r, words, unnest(range(1, len(words) - {n - 2})) as i from texts)"
        for n in sizes
    )
    return rf"""
with texts as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents
), hashed as (
  {windows}
), grams as (
  select r, n, i, count(*) over (partition by r, n, w) > 1 as twice from hashed
), covered as (
  select distinct r, n, unnest(range(i, i + n)) as pos from grams where twice
), placed as (
  select r, length(unnest(words)) as chars, unnest(range(1, len(words) + 1)) as pos from texts
), coverage as (
  select r, count(*) filter (n = {repetition.BASE_WINDOW}) as n_repeat_words, {chars} from covered join placed using (r, pos) group by r
), lines as (
  select r, line, count(*) - 1 as again from (select r, unnest(string_split(text, chr(10))) as line from texts)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by r, line having count(*) > 1
), repeats as (
  select r, sum(again)::bigint as n_dup_lines, sum(again * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::bigint as dup_line_chars from lines group by r
), figures as (
  select t.doc_id, len(t.words)::bigint as n_words, length(array_to_string(t.words, ''))::bigint as word_chars,
    length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(d.n_dup_lines, 0) as n_dup_lines,
    coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words, coalesce(d.dup_line_chars, 0) as dup_line_chars,
    {", ".join(f"coalesce(c.dup_{n}gram_chars, 0) as dup_{n}gram_chars" for n in repetition.LIMITS)}
  from texts t left join coverage c on t.r = c.r left join repeats d on t.r = d.r
), ruled as (
  select *, n_words < {repetition.MIN_WORDS} or 100 * n_repeat_words > {repetition.BASE_PERCENT} * n_words as base_failed from figures
)
select *, not base_failed and 100 * dup_line_chars <= {repetition.LINE_LIMIT} * word_chars and {limits} as kept from ruled
"""


def op9_sql() -> str:
    """Targets by filling sources in turn; thresholds from all 36-bit hash values at once."""
    return r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || left(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 9))::bigint as h
  from documents
), totals as (
  select source, sum(size)::bigint as source_size from sizes group by source
), ranked as (
  select *, (cast([5.0, 2.0, 1.0] as double[]))[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, source_size * 3.0::double as cap
  from totals
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))::double
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from ranked
), targets as (
  select source, source_size, least(cap, greatest(max(level) over (), 0.0) * weight)::double as target from levels
), budgets as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as copies from targets
), cells as (
  select source, h, sum(sum(size)) over (partition by source order by h) as upto, sum(size) as words from sizes group by source, h
), chosen as (
  select c.source, arg_min({'h': c.h, 'below': (c.upto - c.words)::double, 'upto': c.upto::double, 'budget': b.target - b.copies * b.source_size},
    case when c.upto > b.target - b.copies * b.source_size then c.h else 1000000000000 - c.h end) as x
  from cells c join budgets b on c.source is not distinct from b.source group by c.source
), limits as (
  select source, x.h + case when abs(x.upto - x.budget) < abs(x.budget - x.below) then 1 else 0 end as threshold from chosen
)
select s.doc_id, s.size, b.source_size, b.target, s.size * (b.copies + case when s.h < l.threshold then 1 else 0 end) as taken
from sizes s join budgets b on s.source is not distinct from b.source join limits l on s.source is not distinct from l.source
"""


def op13_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Every component of every part against every entry, in each round."""
    steps = [f"""
kept as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda v: floor(v::double * 256)::bigint) as x, len(embedding) // {parts} as width
  from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda v: coalesce(isfinite(v), false))) = len(embedding)
), flat as (
  select r, (i - 1) // width as part, (i - 1) % width as pos, x[i] as v from (select r, x, width, unnest(range(1, len(x) + 1)) as i from kept)
), book0 as (
  select (i - 1) // width as part, entry, (i - 1) % width as pos, x[i] as v
  from (select x, width, entry, unnest(range(1, len(x) + 1)) as i from (select x, width, row_number() over (order by vec_id, x) - 1 as entry from kept) where entry < {entries})
)"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} as (
  select r, part, min({{'d': d, 'entry': entry}}) as m from (
    select f.r, f.part, b.entry, sum((f.v - b.v) * (f.v - b.v))::bigint as d from flat f join book{k} b on f.part = b.part and f.pos = b.pos group by all
  ) group by r, part
)""")
        if k < rounds:
            steps.append(f"""book{k + 1} as (
  select b.part, b.entry, b.pos, coalesce(m.v, b.v) as v from book{k} b left join (
    select f.part, n.m.entry as entry, f.pos, ((sum(f.v) - ((sum(f.v) % count(*)) + count(*)) % count(*)) // count(*))::bigint as v
    from flat f join near{k} n on f.r = n.r and f.part = n.part group by all
  ) m on b.part = m.part and b.entry = m.entry and b.pos = m.pos
)""")
    return "with" + ", ".join(steps) + f""", coded as (
  select r, string_agg(printf('%02x', m.entry), '' order by part) as code, sum(m.d)::bigint as error from near{rounds} group by r
), digest as (
  select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from book{rounds}
)
select k.vec_id, c.code, c.error, sum(c.error) over (partition by k.label)::bigint as label_error, g.codebooks_sha256
from kept k join coded c on k.r = c.r, digest g
"""


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_quality_rank, op2_warc_chunks, op3_byte_bpe, op4_repetition_coverage, op5_chat_format, op6_multiset_fingerprint,
            op7_simhash_components, op8_secret_scan, op9_mix_sources, op10_phrase_automata, op11_whitening, op12_collision_search, op13_cover_tree_codes,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_chunks": OP2_SQL, "op4_repetition_coverage": op4_sql(), "op5_chat_format": OP5_SQL, "op9_mix_sources": op9_sql(),
        "op10_phrase_automata": OP10_SQL, "op13_cover_tree_codes": op13_sql(),
    }
