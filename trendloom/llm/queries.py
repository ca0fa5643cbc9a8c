"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

import os

from . import ann, jaccard, langid, licenses, merkle, mixing, norm_buckets, packing, pii, sharding, syncmers, vector_codes, wrapper_html
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.json"))


def ranks() -> dict[str, str]:
    """The same vocabulary as a ranks file, and its splitting pattern."""
    import public_tokenizers

    return {"ranks": os.fspath(public_tokenizers.path("byte_bpe_50k.tiktoken")), "pattern": public_tokenizers.PATTERN}


QUERIES = {
    "op1_pii": lambda s, d: pii.digest(pii.find(table(s, d, "documents"))),
    "op2_packing": lambda s, d: packing.pack(table(s, d, "documents"), tokenizer_path(), **ranks()),
    "op3_sharding": lambda s, d: sharding.shard(table(s, d, "documents")),
    "op4_mixing": lambda s, d: mixing.mix(table(s, d, "documents")),
    "op5_language_id": lambda s, d: langid.identify(table(s, d, "documents")).select("doc_id", "held_out", "lang_pred", "score"),
    "op6_ann": lambda s, d: ann.search(table(s, d, "embeddings")),
    "op7_fingerprints": lambda s, d: syncmers.fingerprint_edits(table(s, d, "documents")),
    "op8_html": lambda s, d: wrapper_html.extract_pages(table(s, d, "pages")),
    "op9_jaccard": lambda s, d: jaccard.join_components(table(s, d, "documents")),
    "op10_licenses": lambda s, d: licenses.scan(table(s, d, "documents")),
    "op11_vector_codes": lambda s, d: vector_codes.encode(table(s, d, "embeddings")),
    "op12_topk": lambda s, d: norm_buckets.search(table(s, d, "embeddings")),
    "op13_merkle": lambda s, d: merkle.manifest(table(s, d, "documents")),
}


def _codes_sql(rounds: int = 4) -> str:
    """Every round measures all entries (a dot product each); means are floored by whole division."""
    nearest = "select vec_id, part, min(cast(vv - 2 * list_dot_product(p.v, c.v) + cc as bigint) * 256 + entry) as m from parts p join c{0} c using (part) group by all"
    steps = ["c0 as materialized (select part, entry, v, vv as cc from parts join (select vec_id, row_number() over (order by vec_id) - 1 as entry from (select distinct vec_id from kept) order by vec_id limit 256) using (vec_id))"]
    for r in range(rounds):
        steps.append(f"a{r} as materialized ({nearest.format(r)})")
        steps.append(f"""m{r} as (select part, entry, list(mean order by pos) as v from (select part, m & 255 as entry, pos, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as double) as mean
 from (select part, m, unnest(range(1, len(v) + 1)) as pos, cast(unnest(v) as bigint) as x from a{r} join parts using (vec_id, part)) group by all) group by all)""")
        steps.append(f"c{r + 1} as materialized (select part, entry, v, list_dot_product(v, v) as cc from (select part, entry, coalesce(m.v, c.v) as v from c{r} c left join m{r} m using (part, entry)))")
    return f"""with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
 parts as materialized (select *, list_dot_product(v, v) as vv from (select vec_id, p as part, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] as v from kept, range(4) t(p))),
 {", ".join(steps)}, last as materialized ({nearest.format(rounds)}),
 codes as (select vec_id, string_agg(lpad(lower(to_hex(m & 255)), 2, '0'), '' order by part) as code, cast(sum(m // 256) as bigint) as error from last group by vec_id),
 print as (select sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by part, entry, pos)) as codebooks_sha256 from (select part, entry, unnest(range(len(v))) as pos, unnest(v) as x from c{rounds}))
 select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from codes join kept using (vec_id), print"""


def _merkle_sql(levels: int = 10, over: int = 6) -> str:
    """Levels written out one after the other: up to 3^10 rows a source and 3^6 sources."""
    sides = "coalesce(lag(h, 2) over w, '') || coalesce(lag(h) over w, '') as l, coalesce(lead(h) over w, '') || coalesce(lead(h, 2) over w, '') as r"
    level = lambda name, k: f"{name}{k} as materialized (select g, i, n, h, {sides} from {name}b{k} window w as (partition by g, i // 3 order by i))"
    raised = lambda name, k: f"{name}b{k + 1} as (select g, i // 3 as i, (n + 2) // 3 as n, case when n = 1 then max(h) else sha256(string_agg(h, '' order by i)) end as h from {name}{k} group by g, i // 3, n)"
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    whole = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::bigint)"
    steps = [f"ab0 as materialized (select doc_id, g, h, t, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i, count(*) over (partition by g) as n from (select doc_id, coalesce('1' || source, '0') as g, {whole('text')} as h, case when {crc} % 2 = 0 then {whole("replace(text, chr(10), '')")} else {whole('text')} end as t from documents))"]
    for k in range(levels):
        steps += [level("a", k), raised("a", k)]
    steps.append(f"bb0 as (select '' as g, g as source, h, row_number() over (order by g) - 1 as i, count(*) over () as n from ab{levels})")
    for k in range(over):
        steps += [level("b", k), raised("b", k)]
    steps.append("p0 as (select doc_id, g, i, h as leaf, t as f, '' as proof from ab0)")
    fold = "case when x.n = 1 then f else sha256(x.l || f || x.r) end as f, proof || x.l || x.r as proof"
    for k in range(levels):
        steps.append(f"p{k + 1} as (select doc_id, p.g, p.i // 3 as i, leaf, {fold} from p{k} p join a{k} x on x.g = p.g and x.i = p.i)")
    steps.append(f"q0 as (select doc_id, b.i, leaf, f, proof, b.h as subroot from p{levels} p join bb0 b on b.source = p.g)")
    for k in range(over):
        steps.append(f"q{k + 1} as (select doc_id, q.i // 3 as i, leaf, subroot, {fold} from q{k} q join b{k} x on x.i = q.i)")
    return f"with {', '.join(steps)} select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified from q{over}, bb{over}"


# Words split at ASCII white space, A-Z lowered; links by counted common shingles; smallest reachable id.
ORACLE_SQL: dict[str, str] = {
    "op9_jaccard": r"""with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 whole as (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from words where len(w) > 0),
 sets as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from whole),
 sizes as (select doc_id, count(*) as n from sets group by doc_id),
 links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as common from sets x join sets y on x.s = y.s and x.doc_id <> y.doc_id group by all) join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * common >= 80 * (p.n + q.n - common)),
 reach(doc_id, r) as (select doc_id, doc_id from documents union select l.b, reach.r from reach join links l on l.a = reach.doc_id)
 select d.doc_id, coalesce(n, 0) as n_shingles, (select min(r) from reach where reach.doc_id = d.doc_id) as component_id from documents d left join sizes using (doc_id)""",
    "op11_vector_codes": _codes_sql(),
    "op12_topk": """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
 s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
 select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s qualify rank <= 5""",
    "op13_merkle": _merkle_sql(),
}
