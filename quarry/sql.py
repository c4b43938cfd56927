"""The registered queries in the SQL of DuckDB, over the same tables."""

from __future__ import annotations

from quarry.operators import chunking, guard, relevance, tokens
from quarry.operators.answers import UNKNOWN
from quarry.sources import trees

TOKEN = "[A-Za-z_][A-Za-z0-9_./-]*"
SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ENDS = r"\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

DOCS = "docs AS (SELECT DISTINCT ON (id) id, repo_id, file_path, start_line, end_line, symbol_name, symbol_type, chunk_text FROM chunks WHERE id IS NOT NULL AND chunk_text IS NOT NULL)"
ASKED = "asked AS (SELECT DISTINCT repo_id, question FROM eval_items JOIN evals USING (eval_id) WHERE item_no % 20 = 0 AND repo_id IS NOT NULL AND question IS NOT NULL)"
ITEMS = "items AS (SELECT DISTINCT ON (eval_id, item_no) * FROM eval_items)"
RUNS = "runs AS (SELECT DISTINCT ON (eval_id) * FROM evals)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def lines(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN [] ELSE regexp_split_to_array(regexp_replace({x}, '(?:{ENDS})$', ''), '{ENDS}') END"


def filled(x: str) -> str:
    return f"list_filter(list_transform({lines(x)}, lambda l: {strip('l')}), lambda l: l <> '')"


def parts(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[./_ -]+'), lambda p: p <> '')"


def summary(x: str) -> str:
    said = f"array_to_string(CASE WHEN len({filled(x)}) <= 8 THEN {filled(x)} ELSE ({filled(x)})[1:4] END, ' ')"
    return f"left(CASE WHEN {said} = '' THEN 'Relevant code chunk' ELSE {said} END, 220)"


def counts(name: str, source: str, keys: str, fields: dict[str, int]) -> str:
    """CTEs that give ``name (keys, token, tf)``."""
    each = " UNION ALL ".join(f"SELECT {keys}, '{f}' AS field, {w} AS weight, regexp_extract_all({f}, '{TOKEN}') AS raws FROM {source} WHERE {f} IS NOT NULL" for f, w in fields.items())
    return f"""
    {name}_each AS ({each}),
    {name}_raw AS (SELECT {keys}, field, weight, unnest(raws) AS raw, generate_subscripts(raws, 1) AS pos FROM {name}_each),
    {name}_events AS (
      SELECT {keys}, field, weight, pos, lower(raw) AS token, 1 AS is_raw FROM {name}_raw UNION ALL
      SELECT {keys}, field, weight, pos, unnest(list_distinct({parts('raw')})), 0 FROM {name}_raw),
    {name}_fields AS (
      SELECT {keys}, token, field, max(weight) AS weight, sum(is_raw) AS n_raw, min(pos) FILTER (WHERE is_raw = 1) AS first_raw, min(pos) FILTER (WHERE is_raw = 0) AS first_part
      FROM {name}_events GROUP BY {keys}, token, field),
    {name} AS (
      SELECT {keys}, token, CAST(sum(weight * (n_raw + CASE WHEN first_part IS NOT NULL AND (first_raw IS NULL OR first_part < first_raw) THEN 1 ELSE 0 END)) AS BIGINT) AS tf
      FROM {name}_fields GROUP BY {keys}, token)"""


STATS = """
    sizes AS (SELECT repo_id, id, sum(tf) AS dl FROM tf GROUP BY ALL),
    stats AS (SELECT repo_id, count(*) AS n_docs, greatest(avg(coalesce(dl, 0)), 1.0) AS avgdl FROM docs LEFT JOIN sizes USING (repo_id, id) GROUP BY ALL)"""
CORPUS = f"{DOCS}, {counts('tf', 'docs', 'repo_id, id', tokens.FIELD_WEIGHTS)}, {STATS}"
WANTED = counts("wanted", "asked", "repo_id, question", {"question": 1})


def bm25(most: int, variant: str = "simple", name: str = "bm25") -> str:
    idf = "ln(1 + (n_docs - df + 0.5) / (df + 0.5))" if variant == "simple" else "ln(n_docs - df + 0.5) - ln(df + 0.5)"
    usable = "weights" if variant == "simple" else "(SELECT repo_id, token, n_docs, avgdl, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY repo_id) ELSE idf END AS idf FROM weights)"
    return f"""
    weights AS (SELECT repo_id, token, n_docs, avgdl, {idf} AS idf FROM (SELECT repo_id, token, count(*) AS df FROM tf GROUP BY ALL) JOIN stats USING (repo_id)),
    {name}_scored AS (
      SELECT w.repo_id, w.question, t.id, sum(w.tf * u.idf * (t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * greatest(s.dl, 1) / u.avgdl)))) AS score
      FROM wanted w JOIN {usable} u USING (repo_id, token) JOIN tf t ON t.repo_id = w.repo_id AND t.token = w.token JOIN sizes s ON s.repo_id = t.repo_id AND s.id = t.id
      GROUP BY ALL),
    {name} AS (
      SELECT * FROM (
        SELECT b.repo_id, b.question, b.id, b.score, row_number() OVER (PARTITION BY b.repo_id, b.question ORDER BY round(b.score, 9) DESC, file_path, start_line, b.id) AS rank
        FROM {name}_scored b JOIN docs USING (id)) WHERE rank <= {most} AND score > 0)"""


def embedded(name: str, source: str, keys: str, text: str) -> str:
    return f"""
    {name}_tokens AS (SELECT {keys}, token, count(*) AS n FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '{TOKEN}')) AS token FROM {source}) GROUP BY ALL),
    {name} AS (
      SELECT {keys}, CAST('0x' || substr(sha256(token), 7, 2) AS INTEGER) AS ix,
        sum(n * CASE WHEN CAST('0x' || substr(sha256(token), 9, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS v
      FROM {name}_tokens GROUP BY ALL HAVING v <> 0)"""


def cosine(most: int) -> str:
    """CTE ``vec``: every document of the repository is ranked; without a shared bucket its score is 0."""
    return f"""{embedded('dv', 'docs', 'repo_id, id', 'chunk_text')}, {embedded('qv', 'asked', 'repo_id, question', 'question')},
    dots AS (SELECT d.repo_id, q.question, d.id, sum(d.v * q.v) AS dot FROM dv d JOIN qv q USING (repo_id, ix) GROUP BY ALL),
    cosines AS (
      SELECT repo_id, question, id, file_path, start_line, coalesce(CAST(dot AS DOUBLE) / (sqrt(CAST(ds.s AS DOUBLE)) * sqrt(CAST(qs.s AS DOUBLE))), 0) AS score
      FROM asked JOIN docs USING (repo_id) LEFT JOIN dots USING (repo_id, question, id)
        LEFT JOIN (SELECT repo_id, id, sum(v * v) AS s FROM dv GROUP BY ALL) ds USING (repo_id, id)
        LEFT JOIN (SELECT repo_id, question, sum(v * v) AS s FROM qv GROUP BY ALL) qs USING (repo_id, question)),
    vec AS (
      SELECT repo_id, question, id, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id, question ORDER BY round(score, 9) DESC, file_path, start_line, id) AS rank FROM cosines)
      WHERE rank <= {most})"""


FUSED = """
    fused AS (
      SELECT repo_id, question, id, sum(weight / (40 + rank)) AS score, min(rank) FILTER (WHERE leg = 1) AS vr, min(rank) FILTER (WHERE leg = 2) AS br
      FROM (SELECT repo_id, question, id, rank, 0.45::DOUBLE AS weight, 1 AS leg FROM vec UNION ALL SELECT repo_id, question, id, rank, 1.0::DOUBLE, 2 FROM bm25) GROUP BY ALL),
    pooled AS (
      SELECT * FROM (
        SELECT repo_id, question, id, score, row_number() OVER (PARTITION BY repo_id, question ORDER BY round(score, 9) DESC, vr NULLS LAST, br NULLS LAST) AS rank FROM fused)
      WHERE rank <= 60)"""


def diversified(source: str) -> str:
    """CTE ``best`` of a CTE with repo_id, question, id, score, rank: two chunks a file, five a question."""
    return f"""
    nth AS (SELECT s.*, file_path, start_line, end_line, row_number() OVER (PARTITION BY s.repo_id, question, file_path ORDER BY rank) AS n FROM {source} s JOIN docs USING (id)),
    best AS (
      SELECT * EXCLUDE (n, rank), again AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id, question ORDER BY rank) AS again FROM nth WHERE n <= 2) WHERE again <= 5)"""


def words(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def has(*xs: str) -> str:
    return f"list_has_any(tokens, {words(list(xs))})"


def analyzed(source: str, keys: str) -> str:
    """CTEs that give ``analysis``: keys, question, tokens, terms and intents."""
    r = relevance
    return f"""
    analysis_raw AS (SELECT DISTINCT {keys}, regexp_extract_all(question, '{TOKEN}') AS raws FROM {source}),
    analysis_tokens AS (SELECT *, list_distinct(flatten(list_transform(raws, lambda t: list_concat([lower(t)], {parts('t')})))) AS tokens FROM analysis_raw),
    analysis_terms AS (
      SELECT *, list_filter(tokens, lambda t: NOT list_contains({words(r.STOPWORDS)}, t) AND NOT list_contains({words(r.LOW_SIGNAL)}, t) AND length(t) > 2) AS strong,
        list_filter(tokens, lambda t: NOT list_contains({words(r.STOPWORDS)}, t)) AS weak,
        list_distinct(list_filter(list_transform(list_filter(raws, lambda t: regexp_matches(t, '[A-Z.]')), lambda t: regexp_replace(lower(t), '[^a-z0-9]+', '', 'g')),
          lambda t: t <> '' AND NOT list_contains({words(r.STOPWORDS)}, t))) AS written,
        list_filter(tokens, lambda t: list_contains({words(r.SCHEMA)}, t) OR (NOT list_contains({words(r.STOPWORDS)}, t) AND length(t) > 4)) AS fallback
      FROM analysis_tokens),
    analysis_flags AS (
      SELECT {keys}, tokens, CASE WHEN len(strong) > 0 THEN strong ELSE weak END AS important_terms, CASE WHEN len(written) > 0 THEN written ELSE fallback END AS identifier_terms,
        {has('readme')} AS asks_readme, {has('license')} AS asks_license, ({has('report')} AND {has('issues')}) OR ({has('feature')} AND {has('requests')}) AS asks_support,
        {has('feature', 'features')} AS asks_features, {has(*r.DEFINITION)} OR ({has('where', 'which')} AND {has('file', 'files')}) AS asks_definition,
        {has(*r.CONFIGURATION)} AS asks_configuration, {has(*r.SCHEMA)} AS asks_schema, {has('class')} AS asks_class, {has('function')} AS asks_function, {has('method')} AS asks_method
      FROM analysis_terms),
    analysis AS (SELECT *, asks_readme OR asks_license OR asks_support AS asks_documentation FROM analysis_flags)"""


def any_(xs: str, condition: str) -> str:
    return f"len(list_filter({xs}, lambda t: {condition})) > 0"


def assessed(source: str, p: str = "") -> str:
    """CTEs that give ``<p>scored`` from a CTE with repo_id, question, id, score, rank; needs ``docs`` and ``analysis``."""
    said = "concat_ws(' ', file_path, coalesce(symbol_name, ''), coalesce(symbol_type, ''), chunk_text)"
    klass = r"'\b(?:export\s+)?class\s+' || t || '\b'"
    function = r"'\b(?:export\s+)?(?:async\s+)?function\s+' || t || '\b'"
    member = r"'\b(?:public|private|protected)?\s*(?:static\s+)?(?:async\s+)?' || t || '\s*\('"
    constant = r"'\b(?:export\s+)?(?:const|let|var)\s+' || t || '\s*='"
    match = lambda *ps: any_("identifier_terms", " OR ".join(f"regexp_matches(low, {p})" for p in ps))
    return f"""
    {p}paired AS (
      SELECT s.*, a.* EXCLUDE (repo_id, question), d.* EXCLUDE (id, repo_id), lower(file_path) AS path, regexp_extract(lower(file_path), '[^/]*$') AS name, lower(chunk_text) AS low,
        regexp_replace(lower(coalesce(symbol_name, '')), '[^a-z0-9]+', '', 'g') AS symbol, {filled('chunk_text')}[1:6] AS head, regexp_extract_all({said}, '{TOKEN}') AS raws
      FROM {source} s JOIN analysis a ON a.repo_id = s.repo_id AND a.question = s.question JOIN docs d ON d.id = s.id),
    {p}tokened AS (SELECT *, list_distinct(flatten(list_transform(raws, lambda t: list_concat([lower(t)], {parts('t')})))) AS said FROM {p}paired),
    {p}judged AS (
      SELECT *, list_sort(list_intersect(list_distinct(important_terms), said)) AS io, list_sort(list_intersect(list_distinct(identifier_terms), said)) AS do_,
        symbol <> '' AND list_contains(identifier_terms, symbol) AS symbol_exact,
        symbol <> '' AND {any_('identifier_terms', 'length(t) > 3 AND contains(symbol, t)')} AS symbol_partial,
        CASE WHEN len(identifier_terms) = 0 THEN false WHEN asks_class THEN {match(klass)} WHEN asks_function THEN {match(function)}
          WHEN asks_method OR asks_definition THEN {match(member, constant, klass)} ELSE false END AS declares,
        {any_('list_concat(identifier_terms, important_terms)', 'contains(path, t)')} AS path_match,
        CASE WHEN asks_readme THEN name = 'readme.md' WHEN asks_license THEN contains(path, 'license') OR name IN ('readme.md', 'package.json')
          WHEN asks_configuration THEN name = 'package.json' OR starts_with(path, 'config/') OR starts_with(name, 'config.') OR name IN ('default.yml', 'default.yaml')
          WHEN asks_schema THEN {any_(words(relevance.SCHEMA), 'contains(path, t)')} WHEN asks_support OR asks_features THEN name = 'readme.md' ELSE false END AS preferred_file,
        (name IN ('readme.md', 'changelog.md', 'contributing.md') OR starts_with(path, 'docs/')) AND NOT asks_documentation AS docfile,
        len(list_filter({words(relevance.SCHEMA)}, lambda t: contains(path, t) OR contains(low, t))) AS hits,
        len(head) > 0 AND len(list_filter(head, lambda l: starts_with(l, 'import ') OR starts_with(l, 'from '))) >= greatest(2, len(head) - 1) AS imports
      FROM {p}tokened),
    {p}scored AS (
      SELECT *, CASE WHEN len(io) > 0 THEN io ELSE do_ END AS support_terms, round(
        0.2::DOUBLE * score + 0.35::DOUBLE * (len(io) / greatest(1, len(list_distinct(important_terms)))) + 0.15::DOUBLE * (len(do_) / greatest(1, len(list_distinct(identifier_terms))))
        + CASE WHEN symbol_exact THEN 0.45::DOUBLE WHEN symbol_partial THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN declares THEN 0.35::DOUBLE ELSE 0 END
        + CASE WHEN path_match THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN preferred_file THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN docfile THEN -0.08::DOUBLE ELSE 0 END
        + CASE WHEN asks_definition AND start_line <= 40 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN asks_definition AND name = 'package.json' AND NOT asks_configuration THEN -0.15::DOUBLE ELSE 0 END
        + CASE WHEN asks_definition AND docfile THEN -0.18::DOUBLE ELSE 0 END + CASE WHEN asks_definition AND imports AND NOT declares THEN -0.12::DOUBLE ELSE 0 END
        + CASE WHEN asks_configuration AND name = 'package.json' THEN 0.45::DOUBLE ELSE 0 END
        + CASE WHEN asks_configuration AND (contains(chunk_text, '"configuration"') OR contains(chunk_text, 'contributes')) THEN 0.18::DOUBLE ELSE 0 END
        + CASE WHEN asks_configuration AND contains(low, 'codespa.') THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN asks_readme AND name = 'readme.md' THEN 0.45::DOUBLE ELSE 0 END
        + CASE WHEN asks_license AND (contains(path, 'license') OR name IN ('readme.md', 'package.json')) THEN 0.25::DOUBLE ELSE 0 END
        + CASE WHEN asks_support AND name = 'readme.md' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN asks_features AND name = 'readme.md' THEN 0.25::DOUBLE ELSE 0 END
        + CASE WHEN NOT asks_schema THEN 0 WHEN hits > 0 THEN least(0.6::DOUBLE, hits * 0.18::DOUBLE) ELSE -0.24::DOUBLE END, 6) AS assessment
      FROM {p}judged)"""


UNMARKED = r"^[#*\-\s`>]+"


def unmarked(x: str) -> str:
    return strip(f"regexp_replace({x}, '{UNMARKED}', '')")


def answered(source: str) -> str:
    """CTE ``said``: answer and citations of each question, from a CTE as ``assessed`` gives; needs ``docs``."""
    here = "file_path || ':' || start_line || '-' || end_line"
    worth = f"""len(list_intersect(list_distinct(list_transform(regexp_extract_all(x, '[A-Za-z0-9_.-]+'), lambda t: regexp_replace(lower(t), '[^a-z0-9]+', '', 'g'))), identifier_terms))
        + len(list_intersect(list_distinct(regexp_split_to_array(lower(x), '{SPACE}+')), important_terms)) + CASE WHEN regexp_matches(x, '^(### |- |[*] )') THEN 1 ELSE 0 END"""
    return f"""
    nthed AS (SELECT *, row_number() OVER (PARTITION BY repo_id, question ORDER BY assessment DESC, rank) AS nth,
        (symbol_exact OR symbol_partial OR declares OR preferred_file OR path_match OR (assessment >= 0.45 AND len(support_terms) > 0))
        AND (asks_documentation OR NOT (name IN ('readme.md', 'changelog.md', 'contributing.md') OR starts_with(path, 'docs/'))) AS bears FROM {source}),
    firsts AS (SELECT repo_id, question, {here} AS place, nth FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, question, file_path ORDER BY nth) AS f FROM nthed WHERE bears) WHERE f = 1),
    related AS (SELECT repo_id, question, list(place ORDER BY nth)[1:2] AS places FROM firsts GROUP BY ALL),
    tops AS (SELECT n.*, {here} AS here, coalesce(places, [{here}]) AS cites, {filled('chunk_text')} AS rows_, {summary('chunk_text')} AS brief FROM nthed n LEFT JOIN related USING (repo_id, question) WHERE nth = 1),
    weighed AS (SELECT *, list_transform(list_sort(list_filter(list_transform(rows_, lambda x, i: {{'w': -({worth}), 'i': i, 'l': {unmarked('x')}}}), lambda s: s.w < 0)), lambda s: s.l)[1:4] AS best_lines FROM tops),
    pieces AS (SELECT *, CASE WHEN len(best_lines) > 0 THEN 'The retrieved chunk mentions ' || array_to_string(best_lines[1:2], ' ') ELSE brief END AS detail,
        '`' || coalesce(nullif(symbol_name, ''), file_path) || '`' AS subject, list_contains(tokens, 'integration') AND len(cites) > 1 AS joined,
        regexp_extract(chunk_text, '"(codeSpa\\.[^"]+)"\\s*:', 1) AS prop,
        list_filter(list_transform(rows_, lambda x, i: CASE WHEN contains(lower(x), 'rights reserved') THEN {unmarked('x')} WHEN contains(lower(x), 'license') AND i < len(rows_) THEN {unmarked('rows_[i + 1]')} END), lambda x: x IS NOT NULL)[1] AS licence,
        list_transform(list_filter(rows_, lambda x: regexp_matches(lower(x), 'report issues|feature requests|contact support')), lambda x: {unmarked('x')}) AS support,
        list_transform(list_filter(rows_, lambda x: starts_with(x, '### ')), lambda x: {unmarked('x')}) AS headings FROM weighed),
    worded AS (SELECT *, CASE WHEN asks_class THEN subject || ' class' WHEN asks_method THEN subject || ' method' WHEN asks_function THEN subject || ' function' WHEN asks_configuration THEN 'configuration' ELSE 'relevant implementation' END AS descriptor,
        'The strongest grounded match is in `' || here || '`: ' || brief AS generic FROM pieces),
    told AS (SELECT *,
        CASE WHEN asks_configuration AND (prop <> '' OR contains(chunk_text, 'contributes'))
            THEN 'Settings are declared in `' || here || '` under `contributes.configuration.properties`' || CASE WHEN prop <> '' THEN ', including `' || prop || '`' ELSE '' END || '. ' || brief
          WHEN asks_configuration THEN 'The relevant configuration is in `' || here || '`. ' || brief
          WHEN asks_documentation THEN CASE WHEN asks_license AND licence <> '' THEN 'The repo lists `' || licence || '` in `' || here || '`.'
            WHEN asks_support AND len(support) > 0 THEN 'Users can use `' || array_to_string(support[1:2], '` and `') || '`.'
            WHEN asks_features AND len(headings) >= 2 THEN 'The README highlights `' || headings[1] || '` and `' || headings[2] || '`.'
            WHEN len(best_lines) > 0 THEN 'Based on `' || here || '`, ' || array_to_string(best_lines[1:3], ' ') ELSE generic END
          WHEN asks_definition AND joined THEN 'The strongest implementation for ' || descriptor || ' appears in `' || cites[1] || '` and `' || cites[2] || '`. ' || detail
          WHEN asks_definition THEN 'The ' || descriptor || ' is defined in `' || here || '`. ' || detail ELSE generic END AS text_,
        CASE WHEN asks_definition AND NOT asks_configuration AND NOT asks_documentation THEN cites[1:CASE WHEN joined THEN 2 ELSE 1 END] ELSE [here] END AS cited,
        CASE WHEN asks_schema THEN preferred_file OR len(support_terms) > 0
          WHEN asks_configuration THEN preferred_file OR (assessment >= 0.45 AND (contains(lower(chunk_text), 'configuration') OR contains(lower(file_path), 'config')))
          WHEN asks_definition THEN symbol_exact OR symbol_partial OR declares OR (path_match AND assessment >= 0.65) OR (assessment >= 0.4 AND len(support_terms) >= 2)
          WHEN asks_documentation THEN preferred_file OR len(support_terms) > 0 ELSE assessment >= 0.3 AND len(support_terms) > 0 END AS enough FROM worded),
    said AS (SELECT repo_id, question, CASE WHEN enough THEN text_ ELSE '{UNKNOWN.replace("'", "''")}' END AS answer, CASE WHEN enough THEN cited ELSE [] END AS citations FROM told)"""


RETRIEVED = f"""{CORPUS}, {ASKED}, {WANTED}, {bm25(60)}, {cosine(60)}, {FUSED}"""
RERANKED = f"""{RETRIEVED}, {analyzed('asked', 'repo_id, question')}, {assessed('pooled')},
      reranked AS (SELECT repo_id, question, id, assessment AS score, row_number() OVER (PARTITION BY repo_id, question ORDER BY assessment DESC, rank) AS rank FROM scored), {diversified('reranked')}"""
ANSWERED = f"""{RERANKED}, kept AS (SELECT repo_id, question, id, score, rank FROM best), {assessed('kept', 'again_')}, {answered('again_scored')}"""
EVALUATED = f"""{ANSWERED}, {ITEMS}, {RUNS},
    samples AS (SELECT eval_id, item_no, repo_id, question, coalesce(expected_files, []) AS expected, list_distinct(list_transform(coalesce(expected_files, []), lambda f: regexp_extract(f, '[^/]*$'))) AS terms,
        list_distinct(list_transform(coalesce(retrieved_files, []), lambda f: regexp_extract(f, '[^/]*$'))) AS seen FROM items JOIN runs USING (eval_id) WHERE item_no % 20 = 0 AND question IS NOT NULL AND repo_id IS NOT NULL),
    files AS (SELECT repo_id, question, list(file_path ORDER BY rank) AS retrieved FROM best GROUP BY ALL),
    given AS (SELECT * REPLACE (coalesce(retrieved, []) AS retrieved, coalesce(answer, '{UNKNOWN.replace("'", "''")}') AS answer, list_transform(coalesce(citations, []), lambda c: regexp_replace(c, ':[0-9]+-[0-9]+$', '')) AS citations)
      FROM samples LEFT JOIN files USING (repo_id, question) LEFT JOIN said USING (repo_id, question)),
    results AS (SELECT eval_id, item_no, retrieved, expected, answer, len(list_intersect(retrieved[1:3], expected)) > 0 AS hit_3, len(list_intersect(retrieved[1:5], expected)) > 0 AS hit_5,
        coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(retrieved, lambda f, i: CASE WHEN list_contains(expected, f) THEN i END), lambda i: i IS NOT NULL)), 0) AS rr,
        CASE WHEN len(terms) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(terms, lambda t: contains(lower(answer), lower(t)))) / len(terms) END AS matched,
        CASE WHEN answer = '{UNKNOWN.replace("'", "''")}' THEN 1.0::DOUBLE WHEN len(citations) = 0 THEN 0 ELSE len(list_filter(citations, lambda f: list_contains(retrieved, f))) / len(citations) END AS grounded,
        list_concat(list_concat(list_transform(list_filter(seen, lambda t: NOT list_contains(terms, t) AND contains(lower(answer), lower(t))), lambda t: 'must_not_contain:' || t),
          CASE WHEN len(citations) = 0 AND answer <> '{UNKNOWN.replace("'", "''")}' THEN ['missing_citations'] ELSE [] END),
          list_transform(list_filter(citations, lambda f: NOT list_contains(retrieved, f)), lambda f: 'citation_not_retrieved:' || f)) AS flags FROM given)"""
NEAREST = "min(CASE WHEN upto > CAST(round_even({p} / 100.0 * (n - 1), 0) AS BIGINT) THEN latency_ms END) AS p{p}"
LATENCIES = f"""{ITEMS}, {RUNS}, latencies AS (SELECT repo_id, latency_ms FROM items JOIN runs USING (eval_id) WHERE latency_ms IS NOT NULL),
    placed AS (SELECT repo_id, latency_ms, row_number() OVER (PARTITION BY repo_id ORDER BY latency_ms) AS upto, count(*) OVER (PARTITION BY repo_id) AS n FROM latencies)"""
TIGHT = {path: name for name, path, _, _ in guard.POLICIES}
MATCHED = f"""matched AS (
      SELECT DISTINCT ON (request_id) request_id, CASE path {' '.join(f"WHEN '{p}' THEN '{n}'" for p, n in TIGHT.items())} END AS policy, coalesce(client, 'unknown') AS client, epoch_us(ts) AS pos
      FROM requests WHERE method = 'POST' AND request_id IS NOT NULL AND ts IS NOT NULL AND path IN ({', '.join(f"'{p}'" for p in TIGHT)}))"""
WALK = f"""{MATCHED},
      ordered AS (SELECT *, row_number() OVER (PARTITION BY policy, client ORDER BY pos, request_id) AS n FROM matched),
      walk AS (
        SELECT request_id, policy, client, n, pos, true AS accepted, 2 AS remaining, CAST(0 AS BIGINT) AS retry_after, [pos] AS log FROM ordered WHERE n = 1
        UNION ALL
        SELECT o.request_id, o.policy, o.client, o.n, o.pos, len(l.live) < 3, CASE WHEN len(l.live) < 3 THEN 2 - len(l.live) ELSE 0 END,
          CASE WHEN len(l.live) < 3 THEN 0 ELSE greatest(1, CAST(ceil((3600000000 - (o.pos - l.live[1])) / 1000000.0) AS BIGINT)) END, CASE WHEN len(l.live) < 3 THEN list_append(l.live, o.pos) ELSE l.live END
        FROM walk w JOIN ordered o ON o.policy = w.policy AND o.client = w.client AND o.n = w.n + 1, LATERAL (SELECT list_filter(w.log, lambda t: t > o.pos - 3600000000) AS live) l)"""
FOLDERS = "|".join(f.replace(".", r"\.") for f in trees.IGNORED_FOLDERS)
SUFFIX = "lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"
HIT = "len(list_intersect(coalesce(retrieved_files, [])[1:{k}], coalesce(expected_files, []))) > 0"
CITED = "coalesce(list_transform(citations, lambda c: c.file_path), [])"
NAMES = "|".join(chunking.NO_METHODS)


def _shape(kind: str) -> str:
    return f"regexp_extract(line, '{chunking.SCRIPT_SYMBOLS[kind].replace(chr(92) + 's', chunking.SCRIPT_SPACE)}', 1)"


def script_symbols(source: str) -> str:
    """CTE ``symbols (id, symbol_type, symbol_name, first, last)`` of a CTE with id, script and lines ``ls``."""
    return f"""
      rows AS (SELECT id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, len(ls) AS n FROM {source} WHERE script),
      summed AS (SELECT *, coalesce(sum(net) OVER before, 0) AS depth_before, coalesce(sum(opens) OVER before, 0) AS opened_before, sum(net) OVER upto AS depth, sum(opens) OVER upto AS opened
        FROM (SELECT *, {_counted('line', '{')} AS opens, {_counted('line', '{')} - {_counted('line', '}')} AS net FROM rows)
        WINDOW before AS (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), upto AS (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
      shapes AS (SELECT *, {_shape('class')} AS c, {_shape('function')} AS f, {_shape('arrow')} AS a, {_shape('method')} AS m FROM summed),
      ended AS (SELECT s.id, s.line_no, c, f, a, m, coalesce(min(e.line_no), any_value(s.n)) AS last FROM shapes s
        LEFT JOIN summed e ON e.id = s.id AND e.line_no >= s.line_no AND e.opened > s.opened_before AND e.depth <= s.depth_before
        WHERE c <> '' OR f <> '' OR a <> '' OR m <> '' GROUP BY ALL),
      classes AS (SELECT * FROM ended WHERE c <> ''),
      placed AS (SELECT *, EXISTS (SELECT 1 FROM classes k WHERE k.id = e.id AND e.line_no BETWEEN k.line_no AND k.last) AS inside FROM ended e),
      symbols AS (
        SELECT id, 'class' AS symbol_type, c AS symbol_name, line_no AS first, CAST(last AS INTEGER) AS last FROM placed WHERE c <> ''
        UNION ALL SELECT id, 'method', m, line_no, CAST(last AS INTEGER) FROM placed WHERE inside AND m <> '' AND NOT regexp_full_match(m, '{NAMES}')
        UNION ALL SELECT id, 'function', CASE WHEN f <> '' THEN f ELSE a END, line_no, CAST(last AS INTEGER) FROM placed WHERE NOT inside AND (f <> '' OR a <> ''))"""


def _counted(x: str, brace: str) -> str:
    return f"(length({x}) - length(replace({x}, '{brace}', '')))"


SQL = {
    "str1_raw_tokens": f"SELECT token, count(*) AS n, count(DISTINCT id) AS n_chunks FROM (SELECT id, unnest(regexp_extract_all(chunk_text, '{TOKEN}')) AS token FROM chunks) GROUP BY token",
    "str2_code_token_frequencies": f"WITH {DOCS}, {counts('tf', 'docs', 'repo_id, id', {'chunk_text': 1})} SELECT repo_id, token, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY repo_id, token",
    "str3_identifier_parts": f"SELECT DISTINCT symbol_name, array_to_string(list_sort(list_distinct({parts('symbol_name')})), ' ') AS parts FROM chunks WHERE symbol_name IS NOT NULL",
    "str4_normalized_identifiers": "SELECT regexp_replace(lower(symbol_name), '[^a-z0-9]+', '', 'g') AS identifier, count(DISTINCT symbol_name) AS spellings, count(*) AS n FROM chunks WHERE symbol_name IS NOT NULL GROUP BY 1",
    "str8_lines": f"SELECT DISTINCT id, CAST(len({lines('chunk_text')}) AS INTEGER) AS n_lines, CAST(coalesce(list_max(list_transform({lines('chunk_text')}, lambda l: length(l))), 0) AS INTEGER) AS longest FROM chunks",
    "str10_chunk_summaries": f"SELECT DISTINCT id, {summary('chunk_text')} AS summary FROM chunks",
    "str9_markdown_headings": f"""SELECT DISTINCT repo_id, file_path, {strip("regexp_replace(line, '^[#*\\-\\s`>]+', '')")} AS heading FROM (SELECT repo_id, file_path, unnest({filled('chunk_text')}) AS line FROM chunks WHERE language = 'markdown') WHERE starts_with(line, '#')""",
    "prj5_file_languages": f"SELECT DISTINCT repo_id, file_path, CASE {SUFFIX} {' '.join(f"WHEN '{s}' THEN '{n}'" for s, n in trees.LANGUAGES.items())} ELSE 'text' END AS by_suffix, language FROM chunks",
    "flt1_supported_files": f"""WITH {DOCS}, sized AS (SELECT repo_id, file_path, sum(length(chunk_text)) AS size FROM docs GROUP BY ALL),
      judged AS (SELECT *, regexp_matches(file_path, '(^|/)(?:{FOLDERS}|\\.cache[^/]*)/') AS pruned, {SUFFIX} AS suffix FROM sized)
      SELECT repo_id, file_path, pruned, suffix, NOT pruned AND suffix IN ({', '.join(f"'{s}'" for s in trees.LANGUAGES)}) AND size <= 20000
        AND NOT (regexp_extract(file_path, '[^/]*$') IN ({', '.join(f"'{s}'" for s in trees.LOCK_FILES)}) AND size > 5000) AS supported FROM judged""",
    "flt6_printable_share": """WITH heads AS (SELECT DISTINCT id, left(hex(encode(chunk_text)), 2048) AS h FROM chunks),
      bytes AS (SELECT id, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER)) AS b FROM heads),
      shares AS (SELECT id, b, CASE WHEN len(b) = 0 THEN 1.0 ELSE len(list_filter(b, lambda x: x BETWEEN 9 AND 13 OR x BETWEEN 32 AND 126)) / len(b) END AS s FROM bytes)
      SELECT id, round(s, 6) AS printable, list_contains(b, 0) OR s < 0.75 AS binary FROM shares""",
    "prj4_repo_ids": """SELECT DISTINCT repo_url, branch, lower(left(regexp_replace(regexp_replace(rtrim(regexp_replace(repo_url, '^https?://', ''), '/'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 32))
      || '-' || left(sha1(repo_url || '|' || coalesce(branch, 'default')), 8) AS built_id FROM repos""",
    "prj3_chunk_identities": "SELECT DISTINCT id, sha256(chunk_text) = chunk_hash AS hash_fits, repo_id || ':' || file_path || ':' || start_line || '-' || end_line || ':' || left(sha256(chunk_text), 10) = id AS id_fits FROM chunks",
    "src7_chunks_in_order": f"WITH {DOCS} SELECT repo_id, file_path, start_line, end_line, id, CAST(row_number() OVER (PARTITION BY repo_id, file_path ORDER BY start_line, end_line, id) AS INTEGER) AS seq FROM docs",
    "src10_latest_evals": f"WITH {RUNS} SELECT DISTINCT ON (repo_id) repo_id, eval_id, mrr FROM runs ORDER BY repo_id, created_at DESC NULLS LAST, eval_id DESC, mrr DESC",
    "snk1_current_repos": """SELECT DISTINCT ON (repo_id) repo_id, repo_url, branch, commit_sha, files_indexed, chunks_indexed FROM repos
      ORDER BY repo_id, indexed_at DESC NULLS LAST, repo_url DESC NULLS LAST, branch DESC NULLS LAST, commit_sha DESC NULLS LAST, files_indexed DESC NULLS LAST, chunks_indexed DESC NULLS LAST""",
    "agg12_index_counts": "SELECT repo_id, count(DISTINCT file_path) AS files, count(DISTINCT id) AS chunks FROM chunks GROUP BY repo_id",
    "win4_line_windows": f"""WITH cut AS (SELECT doc_id, {lines('text')} AS ls FROM documents WHERE text IS NOT NULL),
      windows AS (SELECT doc_id, ls, unnest(range(0, greatest(0, CAST(ceil((len(ls) - 8) / 6.0) AS BIGINT)) + 1)) * 6 AS b FROM cut WHERE len(ls) > 0),
      texts AS (SELECT doc_id, CAST(b + 1 AS INTEGER) AS start_line, CAST(least(len(ls), b + 8) AS INTEGER) AS end_line, {strip("array_to_string(ls[b + 1 : b + 8], chr(10))")} AS t FROM windows)
      SELECT doc_id, start_line, end_line, md5(t) AS digest FROM texts WHERE t <> ''""",
    "agg10_deduplicated_chunks": "SELECT DISTINCT ON (id) id, commit_sha, symbol_type FROM chunks ORDER BY id, created_at DESC NULLS LAST, commit_sha DESC NULLS LAST, symbol_type DESC NULLS LAST",
    "win6_uncovered_regions": """WITH named AS (SELECT DISTINCT repo_id, file_path, start_line, end_line FROM chunks WHERE symbol_name IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL),
      ends AS (SELECT repo_id, file_path, max(end_line) AS shown FROM chunks WHERE (repo_id, file_path) IN (SELECT (repo_id, file_path) FROM named) GROUP BY ALL),
      regions AS (SELECT * FROM named UNION ALL SELECT repo_id, file_path, shown + 1, shown FROM ends),
      reached AS (SELECT *, coalesce(max(end_line) OVER (PARTITION BY repo_id, file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM regions)
      SELECT repo_id, file_path, CAST(reach + 1 AS INTEGER) AS start_line, CAST(start_line - 1 AS INTEGER) AS end_line FROM reached WHERE start_line > reach + 1""",
    "win5_block_ends": f"""WITH d AS (SELECT DISTINCT ON (id) id, {lines('chunk_text')} AS ls FROM chunks WHERE language IN ('typescript', 'java', 'go', 'cpp', 'javascript') AND id IS NOT NULL AND chunk_text IS NOT NULL),
      rows AS (SELECT id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d WHERE len(ls) > 0),
      depths AS (SELECT id, n, pos, sum({_counted('line', '{')} - {_counted('line', '}')}) OVER w AS depth, sum({_counted('line', '{')}) OVER w AS opened FROM rows
        WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING))
      SELECT id, CAST(any_value(n) AS INTEGER) AS n_lines, CAST(coalesce(min(pos) FILTER (WHERE opened > 0 AND depth <= 0), any_value(n)) AS INTEGER) AS block_end FROM depths GROUP BY id""",
    "sym2_script_symbols": f"""WITH d AS (SELECT DISTINCT ON (id) id, true AS script, {lines('chunk_text')} AS ls FROM chunks
        WHERE language IN ({', '.join(f"'{x}'" for x in chunking.SCRIPT_LANGUAGES)}) AND id IS NOT NULL AND chunk_text IS NOT NULL), {script_symbols('d')}
      SELECT id, symbol_type, symbol_name, first AS start_line, last AS end_line FROM symbols""",
    "sym5_chunked_files": f"""WITH d AS (SELECT id, any_value(language) AS language, any_value(language IN ({', '.join(f"'{x}'" for x in chunking.SCRIPT_LANGUAGES)})) AS script, any_value({lines('chunk_text')}) AS ls FROM chunks
        WHERE coalesce(language, '') <> 'python' AND id IS NOT NULL AND chunk_text IS NOT NULL GROUP BY id), {script_symbols('d')},
      ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first, last, symbol_type) AS seq FROM symbols),
      closed AS (SELECT id, first, last FROM symbols UNION ALL SELECT id, len(ls) + 1, len(ls) FROM d WHERE id IN (SELECT id FROM symbols)),
      reached AS (SELECT *, coalesce(max(last) OVER (PARTITION BY id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM closed),
      regions AS (SELECT id, seq, symbol_type, symbol_name, first, last FROM ordered
        UNION ALL SELECT id, 1000000 + first, 'context', NULL, reach + 1, first - 1 FROM reached WHERE first > reach + 1
        UNION ALL SELECT id, 0, NULL, NULL, 1, len(ls) FROM d WHERE len(ls) > 0 AND id NOT IN (SELECT id FROM symbols)),
      cuts AS (SELECT r.*, language, ls, unnest(range(0, greatest(0, CAST(ceil((last - first + 1 - 16) / 12.0) AS BIGINT)) + 1)) * 12 AS b FROM regions r JOIN d USING (id)),
      windows AS (SELECT id, language, seq, symbol_type, symbol_name, first + b AS start_line, least(last, first + b + 15) AS end_line, {strip("array_to_string(ls[first + b : least(last, first + b + 15)], chr(10))")} AS t FROM cuts),
      kept AS (SELECT DISTINCT ON (id, start_line, end_line, t) * FROM windows WHERE t <> '' ORDER BY id, start_line, end_line, t, seq DESC)
      SELECT id AS chunk, language, symbol_type, symbol_name, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, sha256(t) AS chunk_hash FROM kept""",
    "agg8_hash_embeddings": f"""WITH d AS (SELECT DISTINCT ON (chunk_hash) chunk_hash, chunk_text FROM chunks), {embedded('dv', 'd', 'chunk_hash', 'chunk_text')}
      SELECT chunk_hash, count(*) AS buckets, CAST(sum(v * v) AS BIGINT) AS sumsq, CAST(sum(ix * v) AS BIGINT) AS moment FROM dv GROUP BY chunk_hash""",
    "jn2_missing_embeddings": "SELECT DISTINCT chunk_hash FROM chunks WHERE chunk_hash IS NOT NULL AND chunk_hash NOT IN (SELECT chunk_hash FROM chunks WHERE embedding IS NOT NULL AND chunk_hash IS NOT NULL)",
    "agg25_cache_use": """WITH cached AS (SELECT DISTINCT chunk_hash FROM chunks WHERE embedding IS NOT NULL), hashes AS (SELECT DISTINCT repo_id, chunk_hash FROM chunks)
      SELECT repo_id, count(*) AS hashes, count(c.chunk_hash) AS hits, count(*) - count(c.chunk_hash) AS embedded FROM hashes h LEFT JOIN cached c USING (chunk_hash) GROUP BY repo_id""",
    "srt4_nearest_vectors": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
      pairs AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.e, d.e), 9) AS score FROM v q, v d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
      SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs) WHERE r <= 10""",
    "agg1_corpus_stats": f"WITH {CORPUS} SELECT repo_id, n_docs, round(avgdl, 6) AS avgdl FROM stats",
    "pip5_bm25_top": f"WITH {CORPUS}, {ASKED}, {WANTED}, {bm25(10)} SELECT repo_id, md5(question) AS question_hash, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm25",
    "pip5_bm25_okapi_top": f"WITH {CORPUS}, {ASKED}, {WANTED}, {bm25(10, 'okapi')} SELECT repo_id, md5(question) AS question_hash, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm25",
    "jn5_hash_cosine_top": f"WITH {DOCS}, {ASKED}, {cosine(10)} SELECT repo_id, md5(question) AS question_hash, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM vec",
    "agg5_fused_top": f"WITH {RETRIEVED}, {diversified('pooled')} SELECT repo_id, md5(question) AS question_hash, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM best",
    "nlp1_question_intents": f"""WITH {ITEMS}, texts AS (SELECT DISTINCT question FROM items WHERE question IS NOT NULL), {analyzed('texts', 'question')}
      SELECT md5(question) AS question_hash, asks_readme, asks_license, asks_support, asks_features, asks_definition, asks_configuration, asks_schema, asks_class, asks_function, asks_method, asks_documentation FROM analysis""",
    "nlp2_question_terms": f"""WITH {ITEMS}, texts AS (SELECT DISTINCT question FROM items WHERE question IS NOT NULL), {analyzed('texts', 'question')}
      SELECT md5(question) AS question_hash, array_to_string(list_sort(tokens), ' ') AS tokens, array_to_string(list_sort(important_terms), ' ') AS important_terms,
        array_to_string(list_sort(identifier_terms), ' ') AS identifier_terms FROM analysis""",
    "nlp3_assessed_chunks": f"""WITH {CORPUS}, {ASKED}, {WANTED}, {bm25(10)}, rounded AS (SELECT repo_id, question, id, round(score, 6) AS score, rank FROM bm25), {analyzed('asked', 'repo_id, question')}, {assessed('rounded')}
      SELECT repo_id, md5(question) AS question_hash, id, symbol_exact, symbol_partial, declares, path_match, preferred_file, array_to_string(support_terms, ' ') AS support_terms, assessment FROM scored""",
    "pip4_hybrid_retrieval": f"""WITH {RERANKED}
      SELECT repo_id, question, CAST(rank AS INTEGER) AS rank, id, file_path, start_line, end_line, round(score, 6) AS score, 'hybrid+heuristic' AS source FROM best""",
    "pip7_extractive_answers": f"WITH {ANSWERED} SELECT repo_id, question, answer, array_to_string(citations, ';') AS citations FROM said",
    "pip8_evaluated_items": f"""WITH {EVALUATED}
      SELECT eval_id, item_no, array_to_string(retrieved, ';') AS retrieved, hit_3 AS retrieval_hit_at_3, hit_5 AS retrieval_hit_at_5, round(rr, 6) AS reciprocal_rank, round(matched, 6) AS answer_match,
        round(grounded, 6) AS groundedness, array_to_string(flags, ';') AS flags, md5(answer) AS answer_hash FROM results""",
    "pip8_evaluation_summaries": f"""WITH {EVALUATED}, f AS (SELECT *, len(expected) > 0 AS expects, (len(expected) > 0 AND NOT hit_5) OR len(flags) > 0 OR (matched = 0 AND trim(answer) <> '') AS failed FROM results)
      SELECT eval_id, count(*) AS total_queries, round(coalesce(avg(CASE WHEN hit_3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE expects), 0) + 1e-10, 6) AS recall_at_3,
        round(coalesce(avg(CASE WHEN hit_5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE expects), 0) + 1e-10, 6) AS recall_at_5, round(coalesce(avg(rr) FILTER (WHERE expects), 0) + 1e-10, 6) AS mrr,
        round(avg(matched) + 1e-10, 6) AS answer_match, round(avg(grounded) + 1e-10, 6) AS groundedness, CAST(sum(len(flags)) AS BIGINT) AS flags,
        round(avg(CASE WHEN len(flags) > 0 THEN 1.0 ELSE 0.0 END) + 1e-10, 6) AS hallucination_rate, round(avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END) + 1e-10, 6) AS failure_rate,
        coalesce(array_to_string(list(item_no ORDER BY item_no) FILTER (WHERE failed), ';'), '') AS failed_items FROM f GROUP BY eval_id""",
    "flt8_filtered_vectors": f"""WITH docs AS (SELECT DISTINCT ON (id) id, repo_id, file_path, start_line, chunk_text FROM chunks WHERE id IS NOT NULL AND chunk_text IS NOT NULL AND language = 'typescript' AND symbol_type = 'function'),
      {ASKED}, {cosine(10)} SELECT repo_id, md5(question) AS question_hash, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM vec""",
    "jn15_question_outcomes": f"""WITH {ITEMS}, {RUNS} SELECT repo_id, count(*) AS questions, CASE WHEN repo_id IS NULL OR repo_id NOT IN (SELECT repo_id FROM chunks WHERE repo_id IS NOT NULL)
        THEN 'repository ' || coalesce(repo_id, 'null') || ' is not indexed' END AS error FROM items LEFT JOIN runs USING (eval_id) GROUP BY repo_id""",
    "prj11_prompt_blocks": f"""WITH {CORPUS}, {ASKED}, {WANTED}, {bm25(4)}, blocks AS (
        SELECT b.repo_id, question, string_agg('[C' || rank || '] ' || file_path || ':' || start_line || '-' || end_line || chr(10) || chunk_text, chr(10) || '---' || chr(10) ORDER BY rank) AS t FROM bm25 b JOIN docs USING (id) GROUP BY ALL)
      SELECT repo_id, md5(question) AS question_hash, CAST(length(t) AS INTEGER) AS length, md5(t) AS digest FROM blocks""",
    "win7_hits_and_ranks": f"""WITH {ITEMS} SELECT eval_id, item_no, {HIT.format(k=3)} AS hit_at_3, {HIT.format(k=5)} AS hit_at_5,
      round(coalesce(1.0 / list_min(list_filter(list_transform(range(1, len(coalesce(retrieved_files, [])) + 1), lambda i: CASE WHEN list_contains(coalesce(expected_files, []), retrieved_files[i]) THEN i END), lambda x: x IS NOT NULL)), 0.0), 6) AS reciprocal_rank FROM items""",
    "agg27_groundedness": f"""WITH {ITEMS}, c AS (SELECT *, {CITED} AS cited FROM items)
      SELECT eval_id, item_no, round(CASE WHEN answer = '{UNKNOWN.replace("'", "''")}' THEN 1.0 WHEN len(cited) = 0 THEN 0.0 ELSE len(list_filter(cited, lambda f: list_contains(coalesce(retrieved_files, []), f))) / len(cited) END, 6) AS groundedness,
        array_to_string(list_concat(CASE WHEN len(cited) = 0 AND coalesce(answer, '') <> '{UNKNOWN.replace("'", "''")}' THEN ['missing_citations'] ELSE [] END,
          list_transform(list_filter(cited, lambda f: NOT list_contains(coalesce(retrieved_files, []), f)), lambda f: 'citation_not_retrieved:' || f)), ';') AS flags FROM c""",
    "agg13_eval_summaries": f"""WITH {ITEMS}, f AS (SELECT *, len(coalesce(expected_files, [])) > 0 AS expects, len(coalesce(hallucination_flags, [])) AS n_flags FROM items)
      SELECT eval_id, count(*) AS total_queries,
        round(coalesce(avg(CASE WHEN coalesce(retrieval_hit_at_3, false) THEN 1.0 ELSE 0.0 END) FILTER (WHERE expects), 0) + 1e-10, 6) AS recall_at_3,
        round(coalesce(avg(CASE WHEN coalesce(retrieval_hit_at_5, false) THEN 1.0 ELSE 0.0 END) FILTER (WHERE expects), 0) + 1e-10, 6) AS recall_at_5,
        round(coalesce(avg(coalesce(reciprocal_rank, 0)) FILTER (WHERE expects), 0) + 1e-10, 6) AS mrr, round(avg(coalesce(answer_contains_score, 0)) + 1e-10, 6) AS answer_match,
        round(avg(coalesce(groundedness_score, 0)) + 1e-10, 6) AS groundedness, CAST(sum(n_flags) AS BIGINT) AS flags, round(avg(CASE WHEN n_flags > 0 THEN 1.0 ELSE 0.0 END) + 1e-10, 6) AS hallucination_rate,
        round(avg(coalesce(latency_ms, 0)) + 1e-10, 6) AS average_latency_ms, round(avg(coalesce(estimated_cost_usd, 0)) + 1e-10, 6) AS average_cost,
        round(avg(CASE WHEN (expects AND NOT coalesce(retrieval_hit_at_5, false)) OR n_flags > 0 OR (coalesce(answer_contains_score, 0) = 0 AND trim(coalesce(answer, '')) <> '') THEN 1.0 ELSE 0.0 END) + 1e-10, 6) AS failure_rate
      FROM f GROUP BY eval_id""",
    "agg18_latency_nearest_rank": f"WITH {LATENCIES} SELECT repo_id, max(n) AS n, {', '.join(NEAREST.format(p=p) for p in (50, 95, 99))} FROM placed GROUP BY repo_id",
    "agg20_latency_histograms": f"WITH {LATENCIES} SELECT repo_id, count(*) AS count, CAST(sum(latency_ms) AS BIGINT) AS sum, round(avg(latency_ms), 6) AS avg, {NEAREST.format(p=95)} FROM placed GROUP BY repo_id",
    "jn16_matched_requests": f"WITH {MATCHED} SELECT request_id, policy, client, pos AS \"at\" FROM matched",
    "stm1_limited_requests": f"WITH RECURSIVE {WALK} SELECT request_id, policy, client, accepted, CAST(remaining AS BIGINT) AS remaining, retry_after FROM walk",
    "stm1_limited_stream": f"WITH RECURSIVE {WALK} SELECT request_id, policy, client, accepted, CAST(remaining AS BIGINT) AS remaining, retry_after FROM walk",
    "pip9_request_counters": f"""WITH RECURSIVE {WALK}, seen AS (SELECT DISTINCT ON (request_id) request_id, method, path FROM requests WHERE request_id IS NOT NULL),
      told AS (SELECT method, path, policy, CASE WHEN accepted = false THEN '429' ELSE '200' END AS code FROM seen LEFT JOIN walk USING (request_id))
      SELECT 'http_requests_total' AS name, 'method="' || coalesce(method, '') || '",path="' || coalesce(path, '') || '",status_code="' || code || '"' AS labels, CAST(count(*) AS DOUBLE) AS value FROM told GROUP BY method, path, code
      UNION ALL SELECT 'rate_limit_rejections_total', 'path="' || path || '",policy="' || policy || '"', CAST(count(*) AS DOUBLE) FROM told WHERE code = '429' GROUP BY path, policy""",
    "snk11_histogram_lines": f"""WITH {LATENCIES}, sums AS (SELECT repo_id, count(*) AS n, CAST(sum(latency_ms) AS DOUBLE) AS s, round(avg(latency_ms), 3) AS a, {NEAREST.format(p=95)} FROM placed GROUP BY repo_id),
      each AS (SELECT repo_id, unnest(['count', 'sum', 'avg', 'p95']) AS kind, unnest([CAST(n AS DOUBLE), s, a, CAST(p95 AS DOUBLE)]) AS v FROM sums)
      SELECT 'quarry_eval_latency_ms_' || kind || '{{repo_id="' || repo_id || '"}} ' || CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS line FROM each""",
    "agg19_request_counters": """SELECT 'requests_total' AS name, 'method="' || coalesce(method, '') || '",path="' || coalesce(path, '') || '"' AS labels, CAST(count(*) AS DOUBLE) AS value
      FROM (SELECT DISTINCT ON (request_id) * FROM requests) GROUP BY 2""",
    "snk11_exposition": """SELECT 'quarry_requests_total{method="' || coalesce(method, '') || '",path="' || coalesce(path, '') || '"} ' || count(*) AS line
      FROM (SELECT DISTINCT ON (request_id) * FROM requests) GROUP BY method, path""",
    "jsn1_event_properties": """SELECT event_type, key, count(value) AS n, count(DISTINCT value) AS n_values
      FROM (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events WHERE props IS NOT NULL) e, LATERAL (SELECT json_extract_string(props, '$."' || key || '"') AS value) GROUP BY event_type, key""",
    "stm2_counted_stream": "SELECT method, path, count(*) AS n FROM requests GROUP BY method, path",
}
