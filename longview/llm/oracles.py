"""DuckDB SQL for the queries that SQL can express."""

from .quality import FENCE, MEASURES, MIN_GROUP

_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _op4() -> str:
    cols = [f"{m}_{c}" for m in MEASURES for c in ("lo", "hi")]
    value = {m: f"CASE WHEN {'n_lines' if 'n_lines' in x else 'n_words'} > 0 THEN {x.replace(' div ', ' // ')} ELSE 0 END" for m, (x, _, _) in MEASURES.items()}
    least = "CASE measure " + " ".join(f"WHEN '{m}' THEN {s}" for m, (_, s, _) in MEASURES.items()) + " END"

    def fences(name: str, keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        group = f"GROUP BY {keys}" if keys else ""
        first = f"{keys}, " if keys else ""
        return f"""
    {name}_q AS (SELECT {by}, max(a) AS docs, min(CASE WHEN u * 100 >= a * 25 THEN top END) AS q1, min(CASE WHEN u * 100 >= a * 75 THEN top END) AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS u, sum(n) OVER (PARTITION BY {by}) AS a,
        CASE WHEN bin < 64 THEN bin ELSE (((bin % 64) + 1) << CAST(bin // 64 AS INT)) - 1 END AS top
        FROM (SELECT {by}, bin, CAST(count(*) AS BIGINT) AS n FROM binned GROUP BY {by}, bin)) GROUP BY {by}),
    {name} AS (SELECT {first}max(docs) AS docs, {", ".join(f"max(CASE WHEN measure = '{m}' THEN {'q1 - ' if c == 'lo' else 'q3 + '}{FENCE} * greatest(q3 - q1, {least}) END) AS {m}_{c}" for m in MEASURES for c in ('lo', 'hi'))}
      FROM {name}_q {group})"""

    ok = " AND ".join(f"({value[m]}) <= {m}_hi" + (f" AND ({value[m]}) >= {m}_lo" if low else "") for m, (_, _, low) in MEASURES.items())
    use = ", ".join(f"CASE WHEN own.docs >= {MIN_GROUP} THEN own.{c} WHEN lg.docs >= {MIN_GROUP} THEN lg.{c} ELSE al.{c} END AS {c}" for c in cols)
    return f"""
    WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {_WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
    g AS (SELECT *, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS g FROM w),
    win AS (SELECT doc_id, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM g),
    rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
    cov AS (SELECT doc_id, CAST(sum(least(5, coalesce(nx - i, 5))) AS BIGINT) AS c FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
    m AS (SELECT g.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words FROM g LEFT JOIN cov ON g.doc_id = cov.doc_id),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
    v AS (SELECT lang, source, unnest([{", ".join(f"{{'measure': '{m}', 'x': {x}}}" for m, x in value.items())}], recursive := true) FROM b WHERE NOT base_failed),
    binned AS (SELECT lang, source, measure, CAST(CASE WHEN x < 64 THEN x ELSE (length(bin(x)) - 6) * 64 + (x >> CAST(length(bin(x)) - 6 AS INT)) END AS BIGINT) AS bin FROM v),
    {fences("own", "lang, source")}, {fences("lg", "lang")}, {fences("al", "")},
    lim AS (SELECT own.lang, own.source, {use} FROM own LEFT JOIN lg ON own.lang IS NOT DISTINCT FROM lg.lang CROSS JOIN al)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({ok}, false) AS kept, n_lines
    FROM b LEFT JOIN lim ON b.lang IS NOT DISTINCT FROM lim.lang AND b.source IS NOT DISTINCT FROM lim.source"""


OP4 = _op4()

OP1 = r"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
    c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS LAST, role, text) AS l FROM t GROUP BY conv_id),
    k AS (SELECT *, coalesce(list_max(list_filter(range(1, len(l) + 1), lambda i: l[i].role = 'assistant')), 0) AS k FROM c),
    r AS (SELECT *, CASE WHEN k > 0 THEN array_to_string(list_reverse(string_split(l[k].text, ' ')), ' ') END AS worse FROM k),
    n AS (SELECT *, CASE WHEN k > 0 AND worse <> l[k].text THEN k - 1 ELSE len(l) END AS n FROM r),
    s AS (SELECT *, list_transform(l, lambda x: '<|im_start|>' || x.role || chr(10) || replace(x.text, '<|im_', '<| im_') || '<|im_end|>' || chr(10)) AS m,
      CASE WHEN n < len(l) THEN length('<|im_start|>assistant' || chr(10)) END AS a, replace(worse, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS w FROM n)
    SELECT conv_id, CAST(n AS INTEGER) AS n_prompt_turns, array_to_string(m[1:n], '') AS prompt, array_to_string(m[n + 1:], '') AS chosen,
      CASE WHEN n < len(l) THEN '<|im_start|>assistant' || chr(10) || w || array_to_string(m[n + 2:], '') ELSE '' END AS rejected,
      coalesce(a || '-' || length(m[n + 1]), '') AS chosen_spans, coalesce(a || '-' || (a + length(w)), '') AS rejected_spans FROM s"""

_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))

OP3 = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace('(t,', f"(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),")} AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
    g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    pairs AS (SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON p.u = r.v),
    least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, c = doc_id AS kept FROM s JOIN least ON u = doc_id"""

OP8 = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
    f AS (SELECT payload_digest AS digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1),
    j AS (SELECT d.*, CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to FROM d LEFT JOIN f ON digest = payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j"""

OP9 = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
    f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
    hit AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS new FROM w JOIN f ON f.g = w.g WHERE m < doc_id),
    runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(CASE WHEN new IS NOT FALSE THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit) GROUP BY doc_id, r),
    gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM runs),
    cut AS (SELECT g.doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans, string_agg(substr(x, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a) AS kept, max(b) AS last FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
    SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256 FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id"""
