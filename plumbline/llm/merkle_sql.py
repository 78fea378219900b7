"""The manifest's proofs in DuckDB SQL, by plain levels: a check for trees of at most 16 ** LEVELS rows a source."""

from __future__ import annotations

LEVELS = 4

# crc32 of a text of ASCII characters, bit by bit
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)))"""


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(concat(" + ", ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE concat(strlen({f}), ':', {f}) END" for f in fields) + "))"


def _tree(prefix: str) -> str:
    """Tables {prefix}1 .. of the levels above {prefix}0 (tree, idx, h), and {prefix}w0 .. with each node's siblings."""
    out = []
    for k in range(LEVELS):
        at, run = f"{prefix}{k}", "PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN"
        out.append(f"""{prefix}w{k} AS (
  SELECT tree, idx, h, n, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
         CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {at})
)""")
        out.append(f"""{prefix}{k + 1} AS (
  SELECT tree, idx // 16 AS idx, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE min(h) END AS h
  FROM {prefix}w{k} GROUP BY tree, idx // 16
)""")
    return ",\n".join(out)


def _fold(prefix: str, start: str) -> str:
    """Tables {prefix}f1 .. that carry every row of ``start`` (tree, node, cur, proof) to the next level."""
    out = []
    for k in range(LEVELS):
        before = start if k == 0 else f"{prefix}f{k}"
        out.append(f"""{prefix}f{k + 1} AS (
  SELECT f.* REPLACE (f.node // 16 AS node, CASE WHEN w.n > 1 THEN sha256(concat(w.l, f.cur, w.r)) ELSE f.cur END AS cur, concat(f.proof, w.l, w.r) AS proof)
  FROM {before} f JOIN {prefix}w{k} w ON f.tree = w.tree AND f.node = w.idx
)""")
    return ",\n".join(out)


PROOFS = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC.format(text="CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents
),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
a0 AS (SELECT tree, idx, leaf AS h FROM placed),
{_tree("a")},
b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, h, tree AS source FROM a{LEVELS}),
{_tree("b")},
start AS (SELECT doc_id, leaf, tree AS source, tree, idx AS node, coalesce(changed, leaf) AS cur, '' AS proof FROM placed),
{_fold("a", "start")},
joined AS (SELECT f.* REPLACE (b.tree AS tree, b.idx AS node), b.h AS subroot FROM af{LEVELS} f JOIN b0 b ON f.source = b.source),
{_fold("b", "joined")}
SELECT f.doc_id, f.leaf, f.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = r.h AS verified
FROM bf{LEVELS} f, b{LEVELS} r
"""
