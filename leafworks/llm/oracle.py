"""The queries that SQL can express, in DuckDB's SQL over whole tables."""

from __future__ import annotations

SPACE = "[\\x20\\x09-\\x0D]+"

FINITE = """fine_ as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)"""

ORACLE_SQL = {
    "op5_topk": f"""with {FINITE},
      whole_ as (select vec_id, list_transform(v, lambda x: floor(1024 * x)) as v from fine_),
      pairs_ as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
        from whole_ q join whole_ c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
      select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
      from pairs_ qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10""",
    "op8_substring_dedup": f"""with words_ as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') as words from documents),
      starts_ as (select doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) as i from words_),
      windows_ as (select doc_id, i, md5(array_to_string(words[i:i+19], ' ')) as h from starts_),
      later_ as (select doc_id, i from windows_ qualify row_number() over (partition by h order by doc_id, i) > 1),
      gone_ as (select distinct doc_id, i + unnest(range(20)) as p from later_),
      each_ as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from words_),
      kept_ as (select e.doc_id, count(g.p) as n_removed, string_agg(e.word, ' ' order by e.p) filter (g.p is null) as kept from each_ e left join gone_ g on e.doc_id = g.doc_id and e.p = g.p group by e.doc_id)
      select w.doc_id, len(w.words) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
      from words_ w left join kept_ k on w.doc_id = k.doc_id""",
}
