"""The registered queries of the operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oncemore.llm.boilerplate import op10_boilerplate
from oncemore.llm.decontaminate import op5_decontamination
from oncemore.llm.fim import FIM_PERCENT, MIDDLE, PREFIX, SPM_PERCENT, SUFFIX, op11_fill_in_middle
from oncemore.llm.hmm import op4_hmm
from oncemore.llm.hostrules import MOST_FAILURES, op3_host_rules
from oncemore.llm.hostrules import RULES as HOST_RULES
from oncemore.llm.langid import op1_language_id
from oncemore.llm.minhash import op12_minhash
from oncemore.llm.mixing import op7_mixing
from oncemore.llm.secrets import RULES, op6_secrets
from oncemore.llm.simhash import op9_simhash
from oncemore.llm.suffixdedup import op8_suffix_dedup
from oncemore.llm.toxicity import op2_toxicity
from oncemore.llm.trie import op13_conversation_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_host_rules": op3_host_rules,
    "op4_hmm": op4_hmm,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash": op9_simhash,
    "op10_boilerplate": op10_boilerplate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_minhash": op12_minhash,
    "op13_conversation_trie": op13_conversation_trie,
}


def _secrets_sql() -> str:
    """The base spans and the added ones: texts are split around marked matches, as lengths give the places."""
    branches = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        marked = f"regexp_replace(safe, '{pattern}', chr(1) || '\\0' || chr(2), 'g')"
        branches.append(f"""
  SELECT rid, '{rule.kind}' AS kind, {rank} AS rank, parts, i, parts[i] AS found
  FROM (SELECT rid, parts, unnest(range(2, len(parts) + 1, 2)) AS i
        FROM (SELECT rid, string_split(replace({marked}, chr(2), chr(1)), chr(1)) AS parts FROM texts))
  WHERE length(regexp_extract(parts[i], '{pattern}', {rule.value})) >= {rule.least}""")
    base = sum(r.base for r in RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    text = "kind || ':' || start || ':' || stop, ',' ORDER BY start, rank"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
         translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS safe
  FROM documents
),
matches AS ({" UNION ALL ".join(branches)}),
spans AS (
  SELECT rid, kind, rank, start, start + length(found) AS stop
  FROM (SELECT *, CAST(coalesce(list_sum([length(x) FOR x IN parts[:i - 1]]), 0) AS BIGINT) AS start FROM matches)
)
SELECT doc_id, {counts},
       sha256(coalesce(string_agg({text}) FILTER (rank < {base}), '')) AS base_sha256,
       coalesce(string_agg({text}), '') AS spans
FROM texts LEFT JOIN spans USING (rid) GROUP BY rid, doc_id"""


def _host_rules_sql() -> str:
    failed = ", ".join(f"sum(CASE WHEN {sql} THEN 1 ELSE 0 END) AS {r}" for r, sql in HOST_RULES.items())
    sums = ", ".join(f"sum({r}) AS {r}, sum({r} * {r} / n::DOUBLE) AS {r}_sq" for r in HOST_RULES)
    spread = "(n - nn / n::DOUBLE)"
    sizes, rates = [], []
    for r in HOST_RULES:
        mean = f"({r} / n::DOUBLE)"
        noise = f"({mean} * (1 - {mean}))"
        variance = f"(CASE WHEN {spread} > 0 THEN ({r}_sq - n * {mean} * {mean} - (hosts - 1) * {noise}) / {spread} ELSE 0 END)"
        size = f"CASE WHEN {variance} > 0 THEN {noise} / {variance} - 1 WHEN hosts > 1 AND {noise} > 0 THEN 1000 ELSE 2 END"
        sizes.append(f"least(greatest({size}, 2), 1000) AS {r}_size")
        sizes.append(f"least(greatest({mean}, 0.5::DOUBLE / (n + 1)), 1 - 0.5::DOUBLE / (n + 1)) AS {r}_mean")
        rates.append(f"(h.{r} + {r}_mean * {r}_size) / (h.n + {r}_size)")
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
windows AS (
  SELECT rid, i, words[i:i + 7] AS run
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM texts)
),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, run) > 1),
covered AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
),
measured AS (
  SELECT rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM texts LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)
),
hosts AS (SELECT source, count(*) AS n, {failed} FROM measured GROUP BY source),
totals AS (SELECT count(*) AS hosts, sum(n) AS n, sum(n * n) AS nn, {sums} FROM (SELECT * FROM hosts)),
fitted AS (SELECT {", ".join(sizes)} FROM totals),
verdicts AS (SELECT source, greatest({", ".join(rates)}) <= {MOST_FAILURES} AS host_passes FROM hosts h, fitted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_passes AS kept, host_passes
FROM (SELECT *, {HOST_RULES["short"]} OR {HOST_RULES["repeated"]} AS base_failed FROM measured) m
JOIN verdicts v ON m.source IS NOT DISTINCT FROM v.source"""


def _fill_in_middle_sql() -> str:
    """Tokens as a list: the prefix is the first of them, and so on."""
    word, space = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
    draws = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    marked = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
drawn AS (SELECT doc_id, text, regexp_extract_all(text, '{space}*{word}+|{space}+') AS tokens, {draws} FROM texts),
formed AS (
  SELECT *, len(tokens) AS n,
         CASE WHEN text = '' OR {marked} OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
              WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
         greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b
  FROM drawn
),
cut AS (
  SELECT *, coalesce(array_to_string(tokens[:a], ''), '') AS prefix,
         coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                        ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut"""


def _minhash_sql() -> str:
    """Sets as distinct rows, shared shingles counted by a join, links closed by recursion."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT rid, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM texts WHERE len(words) > 0)
),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
shared AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY ALL
),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b
  WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)
),
reach AS (
  SELECT rid, rid AS other FROM texts
  UNION
  SELECT r.rid, CASE WHEN l.a = r.other THEN l.b ELSE l.a END
  FROM reach r JOIN links l ON r.other IN (l.a, l.b)
),
least AS (SELECT r.rid, min(t.doc_id) AS component_id FROM reach r JOIN texts t ON t.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM texts JOIN least USING (rid) LEFT JOIN sizes USING (rid)"""


def _conversation_trie_sql() -> str:
    """Prefixes as lists; every node is added up over all its ancestors. The crc32 goes bit by bit over the digits."""
    fed = "CASE WHEN k % 8 = 0 THEN xor(v, ascii(digits[k // 8 + 1])) ELSE v END"
    crc = f"xor(list_reduce(range(8 * length(digits)), lambda v, k: xor(({fed}) >> 1, 3988292384 * (({fed}) & 1)), 4294967295), 4294967295)"
    return f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
lengths AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS digits FROM turns GROUP BY conv_id),
convs AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 100 AS base, c.h, least(c.h, coalesce(b.n, 0)) AS got
  FROM (SELECT conv_id, {crc} % 6 AS h FROM lengths) c LEFT JOIN lengths b ON b.conv_id = c.conv_id - c.conv_id % 100
),
made AS (
  SELECT c.conv_id, place, role, text FROM convs c JOIN turns t ON t.conv_id = base AND place <= h
  UNION ALL
  SELECT conv_id, got + place - h, role, text FROM convs JOIN turns USING (conv_id) WHERE place > h
),
paths AS (
  SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY place) FILTER (place IS NOT NULL), []) AS path
  FROM convs LEFT JOIN made USING (conv_id) GROUP BY conv_id
),
prefixes AS (SELECT conv_id, depth, path[:depth] AS key, len(path) AS n FROM (SELECT *, unnest(range(0, len(path) + 1)) AS depth FROM paths)),
nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(length(key[depth].text), 0) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, key
),
children AS (SELECT key[:depth - 1] AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.key = n.key AND c.depth = n.depth),
below AS (
  SELECT up AS depth, key[:up] AS key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.key = c.key AND b.depth = c.depth
LEFT JOIN counted p ON c.depth > 0 AND p.depth = c.depth - 1 AND p.key = c.key[:c.depth - 1]"""


#: The others go beyond SQL (trained models, random draws, closures over links, byte hashes); tests/llm
#: compares each with a plain version.
SQL: dict[str, str] = {
    "op3_host_rules": _host_rules_sql(),
    "op6_secrets": _secrets_sql(),
    "op11_fill_in_middle": _fill_in_middle_sql(),
    "op12_minhash": _minhash_sql(),
    "op13_conversation_trie": _conversation_trie_sql(),
}
