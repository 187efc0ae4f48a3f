"""DuckDB SQL of the operators that SQL can express on a small table."""
from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reach = l.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1"""

SUFFIXES = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS i FROM h WHERE len(h) >= 100)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM g),
b AS (SELECT doc_id, i, substring(h, 2 * i + 1, 2) AS c FROM (SELECT doc_id, h, unnest(range(len(h) // 2)) AS i FROM h)),
k AS (SELECT b.doc_id, b.i, c, coalesce(max(gone::INTEGER) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS cut FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.i = b.i),
t AS (SELECT *, lag(cut, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k),
o AS (SELECT doc_id, sum(cut) AS n_removed, count(*) FILTER (cut = 1 AND before = 0) AS n_spans, string_agg(c, '' ORDER BY i) FILTER (cut = 0) AS kept FROM t GROUP BY 1)
SELECT h.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN o USING (doc_id)"""



#: crc32 (polynomial 0xEDB88320) of an id's decimal digits, bit by bit: each byte is followed by eight steps
CRC32 = (
    "xor(4294967295, list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]), "
    "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
)


def _framed(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


def _tree(name: str, leaves: str, levels: int) -> list[str]:
    """Common tables of the levels of a forest: ``leaves`` has (tree, pos, n, d); each level adds the digests around a node in its run."""
    out, source = [], leaves
    for k in range(levels):
        around = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
        gather = "coalesce(string_agg(d, '') OVER ({} {}), '')"
        before, after = gather.format(around, "16 PRECEDING AND 1 PRECEDING"), gather.format(around, "1 FOLLOWING AND 16 FOLLOWING")
        out.append(f"{name}{k} AS MATERIALIZED (SELECT tree, pos, n, d, {before} AS a, {after} AS z FROM {source})")
        source = f"(SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(a || d || z) ELSE d END AS d FROM {name}{k} WHERE pos % 16 = 0)"
    out.append(f"{name}{levels} AS MATERIALIZED (SELECT tree, d FROM {source})")
    return out


def _merkle(levels: int = 5, upper: int = 3) -> str:
    """Up to 16**levels rows a source and 16**upper sources; a level on which a tree is one node changes nothing."""
    ids = "source, text, doc_id"
    leaf = "sha256(" + " || ".join(map(_framed, ("doc_id", "source", "lang", "n_chars", "text"))) + ")"
    lower = leaf.replace("text::VARCHAR", f"translate(text, '{UPPER}', '{UPPER.lower()}')")
    tables = [
        f"r AS MATERIALIZED (SELECT {ids}, coalesce('s' || source, 'n') AS tree, {leaf} AS d, CASE WHEN crc32_hit THEN {lower} ELSE {leaf} END AS o FROM (SELECT *, coalesce({CRC32} % 5 = 0, false) AS crc32_hit FROM documents))",
        "p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM r)",
        *_tree("l", "p", levels),
        f"t AS MATERIALIZED (SELECT '' AS tree, tree AS name, d, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM l{levels})",
        *_tree("u", "t", upper),
    ]
    joins = " ".join(f"JOIN l{k} ON l{k}.tree = p.tree AND l{k}.pos = p.pos // {16**k}" for k in range(levels))
    joins += " JOIN t ON t.name = p.tree " + " ".join(f"JOIN u{k} ON u{k}.pos = t.pos // {16**k}" for k in range(upper)) + f" JOIN u{upper} ON true"
    nodes = [f"l{k}" for k in range(levels)] + [f"u{k}" for k in range(upper)]
    proof = " || ".join(f"{x}.a || {x}.z" for x in nodes)
    fold = "o"
    steps = []
    for k, x in enumerate(nodes):
        steps.append(f"f{k + 1} AS (SELECT *, CASE WHEN n_{x} > 1 THEN sha256(a_{x} || {fold} || z_{x}) ELSE {fold} END AS g{k + 1} FROM f{k})")
        fold = f"g{k + 1}"
    sides = ", ".join(f"{x}.n AS n_{x}, {x}.a AS a_{x}, {x}.z AS z_{x}" for x in nodes)
    tables.append(f"f0 AS (SELECT p.doc_id, p.d AS leaf, t.d AS subroot, u{upper}.d AS root, sha256({proof}) AS proof_sha256, p.o, {sides} FROM p {joins})")
    return f"WITH {', '.join([*tables, *steps])} SELECT doc_id, leaf, subroot, root, proof_sha256, {fold} AS folded_root, {fold} = root AS verified FROM f{len(nodes)}"


NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10"""

SQL = {"op7_ngram_jaccard_join": JACCARD, "op9_suffix_dedup": SUFFIXES, "op11_multi_index_hard_negatives": NEGATIVES, "op13_merkle_manifest": _merkle()}
