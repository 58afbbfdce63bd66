"""SQL (DuckDB) of the queries of this subpackage that it can express."""

from trackmesh.llm.line_rules import BOILERPLATE, NAVIGATION, SYMBOLS, TERMINAL, LineRules

_SPACE = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = f"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 18)) s from docs where len(w) >= 20),
wins as (select doc_id, s, array_to_string(w[s:s + 19], ' ') k from starts),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) r from wins) where r > 1),
gone as (select doc_id, list(distinct p) ps from (select doc_id, unnest(range(s, s + 20)) p from later) group by doc_id)
select docs.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(ps), 0) as bigint) n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: ps is null or not list_contains(ps, x[2])), lambda x: x[1]), ' ')) kept_sha256
from docs left join gone using (doc_id)"""


def _quality_rules(rules: LineRules = LineRules()) -> str:
    count = lambda text, chars: " + ".join(f"(length({text}) - length(replace({text}, '{c}', '')))" for c in chars)
    terminal = ", ".join("'" + c.replace("'", "''") + "'" for c in TERMINAL)
    phrases = " or ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
    return f"""
with docs as (select row_number() over () rid, doc_id, coalesce(text, '') as text from documents),
words as (select rid, regexp_extract_all(text, '{_SPACE}') w from docs),
lines as (select rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
judged as (
  select rid, line, i, regexp_extract_all(line, '{_SPACE}') lw, {count("line", NAVIGATION)} nav, {count("line", SYMBOLS)} sym,
    length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) chars, right(regexp_replace(line, '[\\x20\\x09-\\x0D]+$', ''), 1) as tail
  from lines where regexp_matches(line, '{_SPACE}')),
failing as (
  select rid, i, line, len(lw) n, ((({phrases}) and len(lw) <= 30) or (nav >= {rules.navigation_marks} and 8 * nav >= len(lw))
    or 100 * sym > {rules.max_symbol_percent} * chars or (len(lw) <= {rules.fragment_words} and tail not in ({terminal}))) bad
  from judged),
by_line as (
  select rid, count(*) filter (where bad) n_lines_removed, coalesce(sum(n) filter (where bad), 0) n_words_removed, count(*) - count(distinct line) n_dup_lines from failing group by rid),
tri as (select rid, unnest(range(1, len(w) - 1)) s, w from words where len(w) >= 3),
twice as (select rid, s from (select rid, s, count(*) over (partition by rid, w[s], w[s + 1], w[s + 2]) c from tri) where c > 1),
rep as (select rid, count(distinct p) n_repeat_words from (select rid, unnest(range(s, s + 3)) p from twice) group by rid),
base as (
  select doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast({count("text", SYMBOLS)} as bigint) n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) n_repeat_words,
    cast(coalesce(n_lines_removed, 0) as bigint) n_lines_removed, cast(coalesce(n_words_removed, 0) as bigint) n_words_removed
  from docs join words using (rid) left join by_line using (rid) left join rep using (rid))
select *, (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) base_failed,
  not (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) and 100 * n_words_removed <= {rules.max_removed_percent} * n_words kept
from base"""


QUALITY_RULES = _quality_rules()
