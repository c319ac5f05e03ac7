"""SQL that checks the registered queries on the same tables."""

from __future__ import annotations

# What the SQL expects, spelled here apart from the code that is checked (fixed values).
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "i", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with")
TEST_WORDS = ("test", "tests", "testing", "tested", "spec", "specs", "mock", "mocks", "fixture", "fixtures", "pytest", "vitest", "jest", "unittest")
CHANGE_WORDS = ("changelog", "changelogs", "release", "releases", "version", "versions", "history", "news", "upgrade", "upgrading", "changed", "change", "changes", "deprecated", "deprecation", "deprecations", "dropped", "introduced", "regression", "migrate", "migrating", "migration")
TEST_PATH = r'(?i)(^|/)(tests?|__tests__|specs?|e2e|integration|fixtures|__mocks__)/|(^|/)(test_[^/]*|conftest\.py)$|_test\.[a-z]+$|\.(test|spec|itest)\.[a-z]+$'
CHANGELOG_PATH = r'(?i)(^|/)(changelog|changes|change[-_]?log|history|news|releases?|release[-_]?notes|whats[-_]?new|upgrading)([-_][0-9][a-zA-Z0-9_.-]*)?(\.(md|markdown|rst|txt))?$'
CODE_EXTENSIONS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sh": "shell", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss", ".vue": "vue", ".svelte": "svelte"}
DOC_EXTENSIONS = {".md": "markdown", ".markdown": "markdown", ".rst": "rst", ".txt": "text"}
CONFIG_EXTENSIONS = {".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".rules": "rules", ".gradle": "gradle", ".xml": "xml"}
CONFIG_NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile", ".gitignore": "gitignore", ".env.example": "dotenv", ".env.sample": "dotenv", ".env.template": "dotenv"}
SECRET_NAME = r'(?i)^(\.env|.*\.pem|.*\.key|.*\.p12|.*\.pfx|.*\.keystore|.*\.jks|id_(rsa|dsa|ecdsa|ed25519)[^/]*|.*firebase-adminsdk.*\.json|.*\.tfstate(\.backup)?|\.npmrc|\.pypirc|\.netrc)$'
ENV_NAME = r'(?i)^\.env\..+$'
ENV_SAMPLE = r'(?i)\.(example|sample|template)$'
SECRET_TEXT = r'-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bgithub_pat_[A-Za-z0-9_]{22}|\bxox[abprs]-[A-Za-z0-9-]{10}|\bAIza[A-Za-z0-9_-]{35}|\bsk-(ant-)?[A-Za-z0-9_-]{20}|\b[sr]k_live_[A-Za-z0-9]{16}'
LOCK_NAMES = ("package-lock.json", "pnpm-lock.yaml", "go.sum", "bun.lockb")
GENERATED_ENDINGS = (".min.js", ".min.css", ".map", ".lock")


def _s(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


FILES = "files as (select * exclude (n) from (select *, row_number() over (partition by repo_id, path order by walked_at desc nulls last, size desc nulls last) n from source_files) where n = 1)"
CHUNKS = "c as (select * exclude (n) from (select *, row_number() over (partition by id) n from chunks) where n = 1)"
ANSWERS = "a as (select * exclude (n) from (select *, row_number() over (partition by result_id) n from answer_results) where n = 1)"
QUESTIONS = ANSWERS + ", q as (select result_id as query_id, question from a where result_id % 20 = 0 and question is not null)"
NAME = "regexp_extract(path, '([^/]*)$', 1)"
EXTENSION = f"lower(regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1))"
LANGUAGE = f"coalesce({_map(CONFIG_NAMES)}[{NAME}], {_map({**CODE_EXTENSIONS, **DOC_EXTENSIONS, **CONFIG_EXTENSIONS})}[{EXTENSION}])"
KIND = f"case when list_contains({_s(CONFIG_NAMES)}, {NAME}) then 'config' else {_map({**dict.fromkeys(CODE_EXTENSIONS, 'code'), **dict.fromkeys(DOC_EXTENSIONS, 'doc'), **dict.fromkeys(CONFIG_EXTENSIONS, 'config')})}[{EXTENSION}] end"


def _tokens(word: str) -> str:
    """The tokens of one word; the parts are found by setting blanks where they begin, since there is no look-ahead."""
    parts = f"regexp_extract_all(regexp_replace(regexp_replace({word}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    return f"list_filter(list_concat(case when len({parts}) <> 1 then [lower({word})] else [] end, list_transform({parts}, lambda p: lower(p))), lambda t: length(t) > 1)"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+')"


def _question_tokens(text: str) -> str:
    return f"list_filter(flatten(list_transform({_words(text)}, lambda w: {_tokens('w')})), lambda t: not list_contains({_s(STOPWORDS)}, t))"


def _distinct_in_order(items: str) -> str:
    return f"list_transform(list_filter(list_zip({items}, range(1, len({items}) + 1)), lambda z: list_position({items}, z[1]) = z[2]), lambda z: z[1])"


POSTINGS = (
    CHUNKS
    + f""", meta as (select id, t, count(*) n from (select id, unnest({_tokens('w')}) t from (select id, unnest({_words("concat_ws(' ', path, symbol)")}) w from c)) group by all),
body as (select id, t, count(*) n from (select id, unnest({_tokens('w')}) t from (select id, unnest({_words('text')}) w from c)) group by all),
p as (select coalesce(meta.t, body.t) as term, coalesce(meta.id, body.id) as id, coalesce(meta.n, 0) as tf_meta, coalesce(body.n, 0) as tf_body from meta full join body on meta.id = body.id and meta.t = body.t)"""
)
BM25 = (
    POSTINGS
    + ", "
    + QUESTIONS
    + f""", qt as (select distinct query_id, t as term from (select query_id, unnest({_question_tokens('question')}) t from q)),
len as (select id, sum(tf_meta + tf_body) l from p group by id), tot as (select count(*) n, avg(l) m from len), df as (select term, count(*) df from p group by term),
w as (select query_id, term, m, case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end idf from qt join df using (term), tot),
s as (select query_id, id, round(sum(idf * (4.0 * tf_meta + tf_body) * 2.2 / ((4.0 * tf_meta + tf_body) + 1.2 * (0.25 + 0.75 * l / m))), 6) score from p join w using (term) join len using (id) group by 1, 2),
hits as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from s qualify rank <= 30)"""
)
VECTORS = "v as (select vec_id, label, embedding::double[] e from embeddings)"


def _cosine(k: int, where: str = "true", name: str = "nn") -> str:
    return f"{name} as (select a.vec_id query_id, b.vec_id id, round(list_cosine_similarity(a.e, b.e), 6) score, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.e, b.e), 6) desc, b.vec_id) as rank from v a, v b where a.vec_id % 20 = 0 and {where} qualify rank <= {k})"


CLAIMS = """lab as (select answer, claim, grader, label from (select *, row_number() over (partition by answer, claim, grader order by graded_at desc nulls last, label_id desc) n from
 (select *, regexp_replace(regexp_replace(lower(support), '^\\s+|\\s+$', '', 'g'), '[\\s_-]+', ' ', 'g') label from (select * from claims qualify row_number() over (partition by label_id) = 1))
 where label in ('supported', 'unsupported', 'contradicted', 'not a claim')) where n = 1)"""
VERDICTS = """ver as (select answer, judge, role, label from (select *, row_number() over (partition by answer, judge order by judged_at desc nulls last, judgement_id desc) n from
 (select *, regexp_replace(regexp_replace(lower(verdict), '^\\s+|\\s+$', '', 'g'), '[\\s_-]+', '_', 'g') label from (select * from judgements qualify row_number() over (partition by judgement_id) = 1))
 where label in ('supported', 'partially_supported', 'unsupported')) x join graders on grader = judge where n = 1)"""
PAIRS = VERDICTS + ", pr as (select m.answer, m.judge, m.label ml, p.label pl from ver m join ver p using (answer) where m.role = 'model' and p.role = 'person')"
STUDY = ANSWERS + ", st as (select *, split_part(results_file, '/', 2) repo, split_part(split_part(results_file, '/', 3), '-', 1) prompt, regexp_extract(split_part(results_file, '/', 3), '^[^-]*-(.*)$', 1) context, regexp_replace(split_part(results_file, '/', 4), '-\\d+\\.json$', '') model, error is not null failed from a)"
GROUNDED = STUDY + ", gp as (select kind, id, min_by(o, result_id) filter (prompt = 'P0') P0, min_by(o, result_id) filter (prompt = 'P1') P1 from (select *, coalesce(question_type, '(none)') kind, coalesce(grounded, false)::int o from st) group by kind, id having P0 is not null and P1 is not null)"
SIGN_P = "case when {b} + {w} = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {w}) + 1), lambda i: exp(lgamma({b} + {w} + 1) - lgamma(i + 1) - lgamma({b} + {w} - i + 1) - ({b} + {w}) * ln(2.0))))) end"
LABEL_RANKS = VECTORS + ", " + _cosine(11) + """, lr as (select query_id, rank, label, row_number() over (partition by query_id order by rank) r from nn join v on v.vec_id = nn.id where query_id <> id),
gr as (select q.vec_id as query_id, min(r) as rank, q.label::varchar as type from v q left join lr on lr.query_id = q.vec_id and lr.label = q.label where q.vec_id % 20 = 0 group by q.vec_id, q.label)"""
DIRS = """f as (select distinct repo_id, path from source_files), ab as (select repo_id, path, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda n: {'d': array_to_string(string_split(path, '/')[1:n], '/'), 'k': n})) x from f),
dr as (select repo_id, x.d as directory, any_value(x.k) as depth, count(*) as files, count(*) filter (len(string_split(path, '/')) = x.k + 1) as direct_files, count(distinct case when len(string_split(path, '/')) > x.k + 1 then string_split(path, '/')[x.k + 1] end) as children from ab group by repo_id, x.d)"""
TEST_DIRS = DIRS + f", td as (select repo_id, directory, files from dr where regexp_matches(directory || '/x', '{TEST_PATH}')), td1 as (select * from td t where not exists (select 1 from td o where o.repo_id = t.repo_id and starts_with(t.directory, o.directory || '/')))"


CLIP = lambda c, n: f"case when length({FLAT(c)}) > {n} then rtrim(substr({FLAT(c)}, 1, {n - 1})) || '…' else {FLAT(c)} end"
FLAT = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
PROSE = "regexp_replace(regexp_replace(answer, '(?s)```.*?```', 'x', 'g'), '`[^`\\n]*`', 'x', 'g')"
#: Numbers in single brackets that follow no name, call or index, as all of these answers cite.
CITED = f"flatten(list_transform(regexp_extract_all({PROSE}, '(^|[^\\w)\\]])((?:\\[[0-9]+\\])+)', 2), lambda g: list_transform(regexp_extract_all(g, '[0-9]+'), lambda v: v::int)))"


def _made_up(row: str) -> str:
    """The reports of an answer's cited numbers against six sources of one made-up file each."""
    return f"""{ANSWERS}, m0 as (select result_id, coalesce(answer, '') as answer from a), m as (select result_id, {CITED} as ns from m0),
 ci as (select result_id, len(ns) as markers, list_filter(list_zip(ns, range(1, len(ns) + 1)), lambda z: list_position(ns, z[1]) = z[2]) as z from m),
 cr as (select result_id, markers, list_transform(list_filter(z, lambda x: x[1] between 1 and 6), lambda x: x[1]) as cited, list_transform(list_filter(z, lambda x: x[1] not between 1 and 6), lambda x: x[1]) as invalid from ci){row}"""


def _greedy(budget: int, most: int, per_file: int) -> str:
    """``fin``: the chosen chunks of each query as lists, by two passes over its ranking."""
    return f"""with recursive {BM25}, r0 as materialized (select query_id, id, concat_ws('/', repo_id, path) path, rank, greatest(1, ceil(length(text) / 4))::bigint tokens from hits join c using (id)),
 it as materialized (select *, row_number() over (partition by query_id order by turn, rank) i from (select 1 turn, * from r0 union all select 2 turn, * from r0)),
 st as (select query_id, 0::bigint i, []::varchar[] ids, []::varchar[] ps, []::bigint[] rk, []::bigint[] tk, 0::bigint used from (select distinct query_id from r0)
  union all select s.query_id, it.i, case when k then list_append(s.ids, it.id) else s.ids end, case when k then list_append(s.ps, it.path) else s.ps end, case when k then list_append(s.rk, it.rank) else s.rk end, case when k then list_append(s.tk, it.tokens) else s.tk end, case when k then s.used + it.tokens else s.used end
  from st s join it on it.query_id = s.query_id and it.i = s.i + 1, lateral (select len(s.ids) < {most} and not list_contains(s.ids, it.id) and len(list_filter(s.ps, lambda p: p = it.path)) < {per_file} and (it.turn = 2 or len(list_filter(s.ps, lambda p: p = it.path)) = 0) and (len(s.ids) = 0 or s.used + it.tokens <= {budget}) k) z),
 fin as (select * from st qualify row_number() over (partition by query_id order by i desc) = 1)"""


def _retrieval() -> str:
    """Vector search as retrieval: a vector's label is its file, a query's own label is gold, the next one acceptable."""
    hits = f"{VECTORS}, {_cosine(11)}, h as (select query_id, id, label, row_number() over (partition by query_id order by rank) r from nn join v on v.vec_id = nn.id where query_id <> id)"
    measures = ["count(*) as questions"]
    for kind, c in (("strict", "rk"), ("lenient", "lrk")):
        measures += [f"round(avg(case when {c} <= {k} then 1.0 else 0.0 end), 6) as {kind}_hit_{k}" for k in (1, 3, 5, 10)] + [f"round(avg(case when {c} <= 10 then 1.0 / {c} else 0.0 end), 6) as {kind}_mrr"]
    measures += ["round(avg(inc::int), 6) as context_recall", "round(avg(linc::int), 6) as lenient_context_recall", "round(avg(sym::int), 6) as symbol_in_context", "round(avg(area), 6) as area_coverage", "0.0 as overview_rate", "round(avg(tokens), 6) as avg_tokens", "round(avg(n), 6) as avg_sources"]
    return f"""with {hits}, fr as (select query_id, label, row_number() over (partition by query_id order by min(r)) fr from h group by query_id, label), q as (select vec_id query_id, label, 'kind' || (label % 3) as type from v where vec_id % 20 = 0),
 x as (select q.*, min(fr.fr) filter (fr.label = q.label) rk, min(fr.fr) filter (fr.label in (q.label, (q.label + 1) % 10)) lrk from q left join fr using (query_id) group by all),
 s as (select query_id, list(label) ls, bool_or(id % 7 = 0) sy, sum(id % 50) tokens, count(*) n from h where r <= 4 group by query_id),
 y as (select x.*, list_contains(ls, label) inc, list_contains(ls, label) or list_contains(ls, (label + 1) % 10) linc, case when query_id % 40 = 0 then sy end sym, case when query_id % 60 = 0 then (list_contains(ls, label)::int + 0) / 2.0 end area, tokens, n from x join s using (query_id))
 select coalesce(type, '(all)') as type, {", ".join(measures)} from y group by rollup (type)"""


def oracle_sql() -> dict[str, str]:
    out = _oracle_sql()
    return out | {"keyword_sources": out["retrieved_sources"]}


def _oracle_sql() -> dict[str, str]:
    mean = lambda e, n: f"round(avg(case when error is null then ({e})::double end), 6) as {n}"
    summary = ", ".join(
        [
            "count(*) as questions", "count(*) filter (error is not null) as errors", mean("coalesce(grounded, false)::int", "grounded_rate"), mean("validity", "citation_validity"), mean("citation_precision", "mean_precision"),
            mean("gold_cited::int", "gold_cited_rate"), mean("uncited_share", "mean_uncited_share"), mean("(coalesce(unverified_locations, 0) > 0)::int", "unverified_location_rate"), mean("coalesce(refused, false)::int", "refusal_rate"),
            mean("coalesce(truncated, false)::int", "truncation_rate"), mean("tokens_in", "avg_tokens_in"), mean("tokens_out", "avg_tokens_out"), mean("seconds", "avg_seconds"),
        ]
    )
    skip = f"""case when regexp_matches({NAME}, '{SECRET_NAME}') or (regexp_matches({NAME}, '{ENV_NAME}') and not regexp_matches({NAME}, '{ENV_SAMPLE}')) then 'secret_file'
 when list_contains({_s(LOCK_NAMES)}, {NAME}) or {' or '.join(f"ends_with({NAME}, '{e}')" for e in GENERATED_ENDINGS)} then 'lockfile_or_generated'
 when ({KIND}) is null then 'unsupported_type' when coalesce(size, strlen(text)) > case when ({KIND}) = 'config' then 200000 else 1000000 end then 'too_large'
 when text is null then 'unreadable' when contains(substr(text, 1, 8192), chr(0)) then 'binary' when not regexp_matches(text, '\\S') then 'empty'
 when ({KIND}) <> 'doc' and list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 2000 then 'minified_or_generated'
 when regexp_matches(text, '{SECRET_TEXT}') then 'secret_pattern' end"""
    windows = f"""n as (select *, length(regexp_replace(text, '\\s+$', '')) - length(replace(regexp_replace(text, '\\s+$', ''), chr(10), '')) + 1 ln, string_split(text, chr(10)) ls from files where regexp_matches(text, '[\\p{{L}}\\p{{N}}_]')),
 w0 as (select *, unnest(range(0, greatest(0, ln - 11) + 1, 50)) s from n), win as (select repo_id, path, (s + 1)::int start_line, least(s + 60, ln)::int end_line, array_to_string(ls[s + 1:least(s + 60, ln)], chr(10)) wt from w0),
 wins as (select * from win where regexp_matches(wt, '[\\p{{L}}\\p{{N}}_]'))"""
    mentions = lambda wanted: f"list_has_any(regexp_extract_all(lower(question), '[a-z]+'), {_s(wanted)})"
    sha = "sha1({})"
    return {
        "file_kinds": f"select distinct repo_id, path, {KIND} as file_kind, {LANGUAGE} as file_language from source_files",
        "skip_reasons": f"with {FILES} select repo_id, path, {skip} as reason from files",
        "walk_report": f"with {FILES}, r as (select repo_id, path, coalesce({skip}, 'indexed') as reason from files), n as (select *, row_number() over (partition by reason order by repo_id, path) k from r) select reason, count(*) as files, string_agg(path, ', ' order by k) filter (k <= 5) as examples from n group by reason",
        "content_hashes": f"with {FILES} select repo_id, path, sha256(text) as hash, sha256(text) = file_hash as same from files",
        "path_flags": f"select distinct path, regexp_matches(path, '{TEST_PATH}') as is_test, regexp_matches(path, '{CHANGELOG_PATH}') as is_changelog, {NAME} as name, {EXTENSION} as extension, len(string_split(path, '/')) as depth from source_files",
        "question_flags": f"select distinct question, {mentions(TEST_WORDS)} as tests, {mentions(CHANGE_WORDS)} as changes from answer_results where question is not null",
        "repo_keys": "select distinct repo_id, regexp_replace(repo_id, '[^A-Za-z0-9_.-]+', '-', 'g') || '-' || left(sha1('https://git.example/teams/' || repo_id || '.git'), 8) as key, not contains(repo_id, '..') and regexp_full_match(repo_id, '[A-Za-z0-9._~/-]+') as accepted, false as with_password, repo_id as name from source_files",
        "window_chunks": f"with {FILES}, {windows} select repo_id, path, start_line, end_line, {sha.format('wt')} as text_hash from wins",
        "chunk_coverage": f"""with {FILES}, {windows}, l as (select repo_id, path, unnest(list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1))) z from files),
 lw as (select repo_id, path, z[2] k from l where regexp_matches(z[1], '[\\p{{L}}\\p{{N}}_]')), cv as (select distinct repo_id, path, unnest(range(start_line, end_line + 1)) k from wins)
 select repo_id, path, count(*) as lines, count(cv.k) as covered from lw left join cv using (repo_id, path, k) group by 1, 2""",
        "chunk_labels": f"""with {CHUNKS} select id, path || ':' || start_line || '-' || coalesce(end_line, start_line) as location, sha1(concat_ws(' • ', nullif(path, ''), nullif(symbol, ''), nullif(kind, '')) || chr(10) || text) as embed_hash,
 sha1(concat_ws('|', repo_id, path, start_line::varchar, coalesce(end_line, start_line)::varchar, sha1(text))) as own_id, greatest(1, ceil(length(text) / 4))::bigint as tokens, regexp_extract(symbol, '([^.]*)$', 1) as leaf, case when contains(symbol, '.') then regexp_extract(symbol, '^(.*)\\.', 1) end as parent from c""",
        "file_heads": f"with {CHUNKS} select repo_id, path, sha1(text) as head_hash from c where start_line = 1 qualify row_number() over (partition by repo_id, path order by end_line nulls first, id) = 1",
        "outline": f"with {CHUNKS} select path, language, kind, symbol, start_line, end_line from c",
        "class_members": f"with {CHUNKS} select k.id, k.symbol, count(m.id) as methods from c k left join c m on m.repo_id = k.repo_id and m.path = k.path and m.kind = 'method' and contains(m.symbol, '.') and regexp_extract(m.symbol, '^(.*)\\.', 1) = k.symbol where k.kind = 'class' group by k.id, k.symbol",
        "query_terms": f"with d as (select distinct question from answer_results where question is not null), t as (select question, {_question_tokens('question')} k from d) select question, coalesce(array_to_string({_distinct_in_order('k')}, ' '), '') as terms from t",
        "postings": f"with {POSTINGS} select term, id, tf_meta, tf_body from p",
        "doc_frequencies": f"with {POSTINGS} select term, count(*) as df from p group by term",
        "doc_lengths": f"with {POSTINGS} select id, sum(tf_meta + tf_body) as length from p group by id",
        "manifest_diff": f"with {FILES}, o as (select distinct concat_ws('/', repo_id, path) path, file_hash h from chunks), n as (select concat_ws('/', repo_id, path) path, file_hash h from files) select coalesce(n.path, o.path) as path, case when o.path is null then 'new' when n.path is null then 'removed' when o.h is not distinct from n.h then 'unchanged' else 'changed' end as status, o.h as old_hash, n.h as new_hash from o full join n on o.path = n.path",
        "index_report": f"with {FILES}, o as (select distinct concat_ws('/', repo_id, path) path, file_hash h from chunks), n as (select concat_ws('/', repo_id, path) path, file_hash h from files), d as (select case when o.path is null then 'new' when n.path is null then 'removed' when o.h is not distinct from n.h then 'unchanged' else 'changed' end s from o full join n on o.path = n.path) select count(*) as files, count(*) filter (s = 'new') as new, count(*) filter (s = 'changed') as changed, count(*) filter (s = 'unchanged') as unchanged, count(*) filter (s = 'removed') as removed from d",
        "stale_chunks": f"with {FILES}, {windows}, o as (select distinct concat_ws('/', repo_id, path) path, id from chunks), nw as (select concat_ws('/', repo_id, path) path, sha1(concat_ws('|', repo_id, path, start_line::varchar, end_line::varchar, sha1(wt))) id from wins) select path, id from o where not exists (select 1 from nw where nw.path = o.path and nw.id = o.id)",
        "bm25_topk": f"with {BM25} select query_id, id, score, rank from hits",
        "hydrated": f"with {BM25} select query_id, rank, id, path, kind, start_line from hits join c using (id)",
        "path_penalty": f"""with {BM25}, x as (select query_id, id, round(score - abs(score) * (1.0 - case when not {mentions(TEST_WORDS)} and regexp_matches(path, '{TEST_PATH}') then 0.5 else 1.0 end), 9) score, rank r from hits join c using (id) join q using (query_id))
 select query_id, id, score, row_number() over (partition by query_id order by score desc, r) as rank from x""",
        "rerank_head_tail": f"""with {BM25}, k as (select query_id, {_question_tokens('question')} t from q), h as (select query_id, id, score, rank r, count(*) over (partition by query_id) z, list_distinct(t) w, list_distinct(list_transform({_words('text')}, lambda x: lower(x))) hv from hits join c using (id) join k using (query_id)),
 f as (select *, round(len(list_intersect(w, hv)) / greatest(1, len(w)), 6) fresh from h), g as (select *, min(case when r <= 10 and z >= 2 then fresh end) over (partition by query_id) fl from f),
 y as (select query_id, id, r, (r <= 10 and z >= 2) ins, case when z < 2 then score when r <= 10 then fresh else round(fl - (r - 10) * 1e-6, 9) end score from g)
 select query_id, id, score, row_number() over (partition by query_id order by case when ins then 0 else 1 end, score desc, r) as rank from y""",
        "ranked_files": f"with {BM25}, x as (select query_id, concat_ws('/', repo_id, path) path, min(rank) chunk_rank from hits join c using (id) group by 1, 2) select query_id, path, chunk_rank, row_number() over (partition by query_id order by chunk_rank, path) as rank from x",
        "vec_topk": f"with {VECTORS}, {_cosine(10)} select query_id, id, score, rank from nn",
        "vec_topk_filtered": f"with {VECTORS}, {_cosine(10, 'b.label < 5')} select query_id, id, score, rank from nn",
        "rrf_fused": f"""with {VECTORS}, {_cosine(20)}, ll as (select a.vec_id query_id, b.vec_id id, row_number() over (partition by a.vec_id order by abs(b.vec_id - a.vec_id), b.vec_id) as rank from v a join v b on a.label = b.label where a.vec_id % 20 = 0 qualify rank <= 20),
 u as (select query_id, id, rank, 1.0 w from nn union all select query_id, id, rank, 0.5 w from ll), g as (select query_id, id, round(sum(w / (60 + rank)), 9) score, min(rank) best from u group by 1, 2) select query_id, id, score, best, row_number() over (partition by query_id order by score desc, best, id) as rank from g""",
        "greedy_select": _greedy(2_000, 8, 2) + " select query_id, unnest(ids) as id, unnest(ps) as path, unnest(rk) as rank, unnest(tk) as tokens, unnest(range(1, len(ids) + 1)) as position from fin",
        "retrieved_sources": _greedy(12_000, 12, 4)
        + """, ch as (select query_id, unnest(ids) as id, unnest(ps) as path, unnest(rk) as rank from fin), sp as (select query_id, ch.id, ch.path, ch.rank, text, start_line, coalesce(end_line, start_line + len(string_split(text, chr(10))) - 1) end_line from ch join c using (id)),
 op1 as (select *, case when start_line > max(end_line) over (partition by query_id, path order by start_line, end_line, id rows between unbounded preceding and 1 preceding) + 1 or row_number() over (partition by query_id, path order by start_line, end_line, id) = 1 then 1 else 0 end op from sp),
 gr1 as (select *, sum(op) over (partition by query_id, path order by start_line, end_line, id rows unbounded preceding) isl from op1), mg as (select query_id, path, isl, min(start_line) start_line, max(end_line) end_line, min(rank) rank from gr1 group by 1, 2, 3),
 ln as (select query_id, path, start_line s0, end_line e0, id, unnest(list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1))) z from sp),
 one as (select query_id, path, s0 + z[2] - 1 n, z[1] line from ln qualify row_number() over (partition by query_id, path, s0 + z[2] order by s0 desc, e0 desc, id desc) = 1),
 tx as (select m.query_id, m.path, m.start_line, string_agg(line, chr(10) order by n) t from mg m join one on one.query_id = m.query_id and one.path = m.path and n between m.start_line and m.end_line group by all)
 select query_id, path, start_line, end_line, rank, 'match' as role, greatest(1, ceil(length(t) / 4))::bigint as tokens, sha1(t) as text_hash from mg join tx using (query_id, path, start_line)""",
        "merged_spans": f"""with {CHUNKS}, s as (select repo_id, path, kind, symbol, id, start_line, coalesce(end_line, start_line) end_line from c),
 o as (select *, case when start_line > max(end_line) over (partition by repo_id, path order by start_line, end_line, id rows between unbounded preceding and 1 preceding) + 1 or row_number() over (partition by repo_id, path order by start_line, end_line, id) = 1 then 1 else 0 end op from s),
 g as (select *, sum(op) over (partition by repo_id, path order by start_line, end_line, id rows unbounded preceding) isl from o),
 m as (select repo_id, path, isl, min(start_line) start_line, max(end_line) end_line, list(symbol order by start_line, end_line, id) filter (symbol is not null and symbol <> '') sy, list(kind order by start_line, end_line, id) kd, bool_and(kind = 'class') cx, count(*) n from g group by 1, 2, 3)
 select repo_id, path, start_line, end_line, coalesce(array_to_string({_distinct_in_order('sy')}, ','), '') as symbols, array_to_string({_distinct_in_order('kd')}, ',') as kinds, start_line as rank, case when cx then 'context' else 'match' end as role, n as chunks from m""",
        "context_prefix": f"with {BM25}, x as (select query_id, id, row_number() over w as position, sum(greatest(1, ceil(length(text) / 4))) over (partition by query_id order by rank rows unbounded preceding) run from hits join c using (id) window w as (partition by query_id order by rank)) select query_id, id, position from x where position = 1 or run <= 1500",
        "context_budgets": "select window_name, max_tokens, greatest(1000, least(12000, floor((capacity_tokens - least(max_tokens, 1000) - 1500) / 1.4)))::bigint as budget from context_windows, (values (400), (2000)) t(max_tokens)",
        "gold_ranks": f"with {LABEL_RANKS} select query_id, rank, type from gr",
        "ranking_report": f"with {LABEL_RANKS} select coalesce(type, '(all)') as type, count(*) as questions, {', '.join(f'round(avg(case when rank <= {k} then 1.0 else 0.0 end), 6) as hit_{k}' for k in (1, 3, 5, 10))}, round(avg(case when rank <= 10 then 1.0 / rank else 0.0 end), 6) as mrr from gr group by rollup (type)",
        "misses": f"with {LABEL_RANKS} select query_id, rank, type from gr where rank is null or rank > 1",
        "paired_rankings": f"""with {LABEL_RANKS}, {_cosine(11, 'b.label % 2 = 0', 'ev')}, fr as (select query_id, min(rank) r2 from ev join v o on o.vec_id = ev.id join v s on s.vec_id = ev.query_id where query_id <> id and o.label = s.label group by 1)
 select query_id, round(case when rank <= 10 then 1.0 / rank else 0.0 end, 6) as a, round(case when r2 <= 10 then 1.0 / r2 else 0.0 end, 6) as b, 'all-even' as pair from gr left join fr using (query_id)""",
        "paired_counts": f"""with {LABEL_RANKS}, {_cosine(11, 'b.label % 2 = 0', 'ev')}, fr as (select query_id, min(rank) r2 from ev join v o on o.vec_id = ev.id join v s on s.vec_id = ev.query_id where query_id <> id and o.label = s.label group by 1),
 x as (select round(case when rank <= 10 then 1.0 / rank else 0.0 end, 6) - round(case when r2 <= 10 then 1.0 / r2 else 0.0 end, 6) d from gr left join fr using (query_id)),
 y as (select count(*) n, round(avg(d), 6) mean_diff, count(*) filter (d > 0) better, count(*) filter (d < 0) worse, count(*) filter (d = 0) tied from x) select 'all-even' as pair, n, mean_diff, better, worse, tied, round({SIGN_P.format(b='better', w='worse')}, 6) as sign_p from y""",
        "answer_summary": f"with {ANSWERS}, b as (select * replace (coalesce(question_type, '(none)') as question_type) from a) select coalesce(question_type, '(all)') as question_type, {summary} from b group by rollup (question_type)",
        "area_coverage": f"with {TEST_DIRS}, sh as (select distinct repo_id, path from chunks), cv as (select repo_id, directory, exists (select 1 from sh where sh.repo_id = td1.repo_id and starts_with(sh.path, directory || '/')) h from td1) select repo_id as query_id, round(avg(h::int), 6) as coverage from cv group by repo_id",
        "judge_agreement": f"with {PAIRS}, s as (select judge, list_position(['unsupported', 'partially_supported', 'supported'], ml) x, list_position(['unsupported', 'partially_supported', 'supported'], pl) y from pr) select judge, count(*) as compared, count(*) filter (x = y) as matching, count(*) filter (abs(x - y) <= 1) as within_one_step from s group by judge",
        "judge_kappa": f"""with {PAIRS}, t as (select judge, count(*) n, count(*) filter (ml = pl) s from pr group by judge), m1 as (select judge, ml l, count(*) x from pr group by 1, 2), m2 as (select judge, pl l, count(*) y from pr group by 1, 2), e as (select judge, sum(x * y) xy from m1 join m2 using (judge, l) group by judge)
 select judge, n, round(s / n, 6) as observed, round(coalesce(xy, 0) / (n * n), 6) as expected, round(case when coalesce(xy, 0) / (n * n) < 1 then (s / n - coalesce(xy, 0) / (n * n)) / (1 - coalesce(xy, 0) / (n * n)) end, 6) as kappa from t left join e using (judge)""",
        "claim_alpha": f"""with {CLAIMS}, u as (select answer, claim, label, count(*) c from lab group by all), z as (select answer, claim, sum(c) m, sum(c * (c - 1)) s from u group by 1, 2 having sum(c) >= 2), t as (select label, sum(c) t from u join z using (answer, claim) group by label),
 tt as (select sum(t) n, sum(t * t) sq from t), g as (select count(*) units, sum(s / (m - 1)) dg from z) select units, n as "values", round(case when n * n - sq > 0 then 1 - (n - 1) * (n - dg) / (n * n - sq) end, 6) as alpha from g, tt""",
        "judge_alpha": f"""with {VERDICTS}, u as (select role, answer, label, count(*) c from ver group by all), z as (select role, answer, sum(c) m, sum(c * (c - 1)) s from u group by 1, 2 having sum(c) >= 2), t as (select role, label, sum(c) t from u join z using (role, answer) group by 1, 2),
 tt as (select role, sum(t) n, sum(t * t) sq from t group by role), g as (select role, count(*) units, sum(s / (m - 1)) dg from z group by role) select role, units, n as "values", round(case when n * n - sq > 0 then 1 - (n - 1) * (n - dg) / (n * n - sq) end, 6) as alpha from g join tt using (role)""",
        "reported_agreement": "select judge, count(*) as runs, sum(compared) as compared, sum(matching) as matching, round(sum(matching) / sum(case when matching is not null then compared end), 6) as rate, count(*) filter (matching > compared) as impossible from (select distinct * from agreements) where compared > 0 group by judge",
        "condition_summary": f"with {STUDY} select prompt, context, count(*) as answers, round(avg(grounded::int), 6) as mean_grounded, round(avg(failed::int), 6) as mean_failed, round(avg(citation_precision), 6) as mean_citation_precision, round(avg(gold_cited::int), 6) as mean_gold_cited from st group by 1, 2",
        "paired_conditions": f"with {GROUNDED} select kind, id, P0, P1 from gp",
        "prompt_gain": f"with {GROUNDED}, y as (select kind, count(*) n, round(avg(P0), 6) mean_first, round(avg(P1), 6) mean_second, count(*) filter (P0 = 0 and P1 = 1) gained, count(*) filter (P0 = 1 and P1 = 0) lost from gp group by kind) select *, round({SIGN_P.format(b='gained', w='lost')}, 6) as p from y",
        "prompt_gain_holm": f"""with {GROUNDED}, y as (select kind, count(*) filter (P0 = 0 and P1 = 1) g, count(*) filter (P0 = 1 and P1 = 0) l from gp group by kind), z as (select kind as name, round({SIGN_P.format(b='g', w='l')}, 6) p from y),
 h as (select *, least(1.0, (count(*) over () - row_number() over (order by p, name) + 1) * p) s from z) select name, p, round(max(s) over (order by p, name rows unbounded preceding), 6) as p_holm from h""",
        "complete_cases": f"with {STUDY} select model, count(*) as answers from st s where not exists (select 1 from st f where f.failed and f.model = s.model and f.repo = s.repo and f.id = s.id) group by model",
        "error_sources": f"with {STUDY} select prompt, case when gold_cited is null then 'unanswerable' when gold_cited then 'gold' else 'other' end as cited, count(*) as answers, sum(coalesce(grounded, false)::int) as grounded, sum((coalesce(unverified_locations, 0) > 0)::int) as unverified from st where not failed group by 1, 2",
        "claim_fold": f"with {CLAIMS} select answer, claim, case when max(case label when 'contradicted' then 2 when 'unsupported' then 1 when 'supported' then 0 end) is null then 'not a claim' else ['supported', 'unsupported', 'contradicted'][max(case label when 'contradicted' then 2 when 'unsupported' then 1 when 'supported' then 0 end) + 1] end as label from lab group by 1, 2",
        "faithful_answers": f"with {CLAIMS}, f as (select answer, claim, max(case label when 'contradicted' then 2 when 'unsupported' then 1 when 'supported' then 0 end) w from lab group by 1, 2) select answer, count(*) as claims, bool_and(w = 0) as faithful from f where w is not null group by answer",
        "grader_kappa": f"""with {CLAIMS}, pr as (select a.grader as first, b.grader as second, a.label x, b.label y from lab a join lab b using (answer, claim) where a.grader < b.grader), t as (select first, second, count(*) n, count(*) filter (x = y) s from pr group by 1, 2),
 m1 as (select first, second, x l, count(*) cx from pr group by 1, 2, 3), m2 as (select first, second, y l, count(*) cy from pr group by 1, 2, 3), e as (select first, second, sum(cx * cy) xy from m1 join m2 using (first, second, l) group by 1, 2)
 select first, second, n, round(s / n, 6) as observed, round(coalesce(xy, 0) / (n * n), 6) as expected, round(case when coalesce(xy, 0) / (n * n) < 1 then (s / n - coalesce(xy, 0) / (n * n)) / (1 - coalesce(xy, 0) / (n * n)) end, 6) as kappa from t left join e using (first, second)""",
        "judge_subsets": f"with {PAIRS}, s as (select 'all' as subset, * from pr union all select 'not_supported', * from pr where pl <> 'supported' union all select 'extreme', * from pr where pl <> 'partially_supported') select subset, judge, count(*) as pairs, round(avg((ml = pl)::int), 6) as accuracy from s group by 1, 2",
        "experiment_jobs": "select g.grader as model, m.source as repo, x.prompt, x.context from (values ('P0', 'live', null), ('P1', 'frozen', ['judge-m00', 'judge-m01'])) x(prompt, context, models), graders g, mix_targets m where g.role = 'model' and (x.models is null or list_contains(x.models, g.grader))",
        "determinism": f"with {STUDY}, p as (select repo, prompt, id, count(*) runs, count(distinct answer) texts from st where answer is not null group by 1, 2, 3) select repo, prompt, count(*) as repeated, count(*) filter (texts = 1) as identical from p where runs > 1 group by 1, 2",
        "review_sample": f"with {ANSWERS}, {VERDICTS} select result_id, code from a where code in (select answer from ver) order by md5('0|' || result_id), result_id limit 50",
        "resume_run": f"with {ANSWERS}, r as (select id, error is not null or not coalesce(grounded, false) as bad from a) select distinct id from r where bad and id not in (select id from r where not bad)",
        "failed_answers": f"with {ANSWERS}, r as (select id, error is not null or not coalesce(grounded, false) as bad from a) select id, count(*) as runs, count(*) filter (bad) as failed from r group by id having count(*) filter (bad) > 0",
        "citation_counts": f"""with {ANSWERS}, x as (select result_id, cited, list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(answer, '(?s)```.*?```', ' ', 'g'), '`[^`\\n]*`', ' ', 'g'), ' \\[([0-9]+)\\]', 1), lambda v: v::int)) f from a where answer is not null)
 select result_id, len(f) as found, len(coalesce(cited, [])) as reported, len(list_filter([1, 2, 3, 4, 5, 6], lambda n: not list_contains(f, n))) as uncited_of_6 from x""",
        "answer_warnings": f"""with {ANSWERS} select result_id, case when coalesce(no_context, false) then 'No relevant code was found, so nothing was answered.' else concat_ws(' ', case when coalesce(refused, false) then 'The model declined to answer.' when not coalesce(grounded, false) then 'The answer cites no retrieved code.' end, case when coalesce(truncated, false) then 'The answer was cut off.' end) end as notes from a""",
        "claims_by_rule": "select case when coalesce(length(trim(cites)), 0) = 0 then 'rule' else 'model' end as by, count(*) as claims from (select * from claims qualify row_number() over (partition by label_id) = 1) group by 1",
        "text_forms": f"""with {ANSWERS}, x as (select *, trim(regexp_replace(answer, '\\s+', ' ', 'g')) fl from a where answer is not null) select result_id, case when length(fl) > 80 then rtrim(substr(fl, 1, 79)) || '…' else fl end as clipped, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(answer, '`+'), lambda r: length(r))), 0) + 1)) as fence,
 case when substr(answer, 1, 1) in ('=', '+', '-', '@') then '''' || answer else answer end as cell, len({_words('answer')}) as words from x""",
        "retrieval_report": _retrieval(),
        "cited_numbers": "with " + _made_up("") + " select result_id, list_aggregate(cited, 'string_agg', ',') as cited, list_aggregate(invalid, 'string_agg', ',') as invalid, markers as marker_count, len(cited) > 0 as grounded, case when len(cited) + len(invalid) > 0 then len(cited) / (len(cited) + len(invalid)) end as validity from cr",
        "answer_scores": "with " + _made_up("") + """ select result_id as query_id, case when result_id % 5 = 0 then 'unanswerable' else 'locate' end as type, len(cited) > 0 as grounded,
 case when result_id % 5 <> 0 and len(cited) > 0 then round(len(list_filter(cited, lambda n: n = 1 + result_id % 6 or n = 1 + (result_id + 1) % 6 or (n <= 2 and result_id % 4 = 0))) / len(cited), 6) end as precision,
 case when result_id % 5 <> 0 then (list_contains(cited, 1 + result_id % 6) or list_contains(cited, 1 + (result_id + 1) % 6))::int end as gold_cited, round((6 - len(cited)) / 6.0, 6) as uncited_share from cr""",
        "gold_supplied": f"with {ANSWERS} select result_id, case when length(question) % 3 = 0 then null else (length(question) % 4 = length(question) % 6)::int end as gold_supplied from a where question is not null",
        "judge_kappa_units": f"""with {PAIRS}, t as (select judge, count(*) n, count(distinct answer) units, count(*) filter (ml = pl) s from pr group by judge), m1 as (select judge, ml l, count(*) x from pr group by 1, 2), m2 as (select judge, pl l, count(*) y from pr group by 1, 2), e as (select judge, sum(x * y) xy from m1 join m2 using (judge, l) group by judge)
 select judge, n, units, round((s / n - xy / (n * n)) / (1 - xy / (n * n)), 6) as estimate, true as inside from t join e using (judge)""",
        "paired_intervals": "with " + LABEL_RANKS + ", " + _cosine(11, "b.label % 2 = 0", "ne") + """, fb as (select ne.query_id, min(ne.rank) r from ne join v o on o.vec_id = ne.query_id join v t on t.vec_id = ne.id where ne.query_id <> ne.id and o.label = t.label group by 1)
 select 'all-even' as pair, count(*) as n, round(avg(case when rank <= 10 then round(1.0 / rank, 6) else 0 end - case when r <= 10 then round(1.0 / r, 6) else 0 end), 6) as mean_diff, true as inside from gr left join fb using (query_id)""",
        "structured_coverage": f"with {FILES} select true as complete, count(*) as files from files where regexp_matches(text, '[\\p{{L}}\\p{{N}}_]')",
        "condense_prompts": f"with {ANSWERS}, l as (select results_file c, result_id t, question, answer from a where answer is not null qualify row_number() over (partition by results_file order by result_id desc) <= 3) select c as conv_id, sha1('<conversation>' || chr(10) || chr(10) || string_agg('User: ' || ({CLIP('question', 300)}) || chr(10) || 'Assistant: ' || ({CLIP('answer', 600)}), chr(10) || chr(10) order by t) || chr(10) || chr(10) || '</conversation>') as message_hash from l group by c",
        "last_turns": f"with {ANSWERS} select results_file as conv_id, result_id as turn, question from a where answer is not null qualify row_number() over (partition by results_file order by result_id desc) <= 3",
        "hashed_questions": f"""with d as (select distinct question from answer_results where question is not null), t as (select question, unnest(flatten(list_transform({_words('question')}, lambda w: {_tokens('w')}))) k from d),
 h as (select question, ('0x' || substr(md5(k), 31, 2))::int % 64 axis, count(*)::double n from t group by 1, 2), z as (select question, sqrt(sum(n * n)) l from h group by 1), e as (select question, 0 axis, 1.0 n, 1.0 l from d where question not in (select question from h))
 select question, axis, round(n / l, 6) as "value" from h join z using (question) union all select question, axis, 1.0 from e""",
        "map_directories": f"with {DIRS}, li as (select * from dr where not (direct_files = 0 and children = 1)) select l.repo_id, l.directory, l.depth, l.files, l.direct_files, l.children, (select count(*) from li o where o.repo_id = l.repo_id and (o.directory = l.directory or starts_with(l.directory, o.directory || '/'))) as shown_depth from li l",
        "directory_languages": """with f as (select distinct repo_id, path, language from source_files where language is not null), ab as (select repo_id, path, language, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))) directory from f),
 n as (select repo_id, directory, language, count(*) n, min(path) p from ab group by 1, 2, 3), r as (select *, row_number() over (partition by repo_id, directory order by n desc, p, language) k from n) select repo_id, directory, string_agg(language, ', ' order by k) as languages from r where k <= 2 group by 1, 2""",
        "directory_symbols": f"""with {CHUNKS}, s as (select repo_id, regexp_extract(path, '^(.*)/', 1) directory, symbol, case kind when 'class' then 0 when 'type' then 1 when 'function' then 2 end k, -(coalesce(end_line, start_line) - start_line) z from c
 where symbol is not null and symbol <> '' and not contains(symbol, '.') and not starts_with(symbol, '_') and not regexp_matches(path, '{TEST_PATH}') and kind in ('class', 'type', 'function') and contains(path, '/')),
 o as (select * from s qualify row_number() over (partition by repo_id, directory, symbol order by k, z) = 1), r as (select *, row_number() over (partition by repo_id, directory order by k, z, symbol) n from o) select repo_id, directory, string_agg(symbol, ', ' order by n) as symbols from r where n <= 4 group by 1, 2""",
        "test_directories": f"with {TEST_DIRS} select repo_id, directory, files from td1",
        "event_windows": "select date_trunc('day', ts) as start, event_type, count(*) as events, round(sum(\"value\"), 2) as \"value\" from events group by 1, 2",
        "event_examples": "with r as (select *, row_number() over (partition by event_type order by event_id) k from events) select event_type, count(*) as n, string_agg(event_id::varchar, ',' order by event_id) filter (k <= 5) as examples from r group by 1",
        "customers_without_orders": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '1998-01-01')",
        "orders_with_returns": "select o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') group by 1",
        "revenue_by_nation": "select n_name, year(l_shipdate) as year, sum(floor(l_extendedprice * (1 - l_discount) * 100)::bigint)::bigint as revenue_cents, count(*) as lines from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
    }
