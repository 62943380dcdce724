"""Registered queries of field discovery, typed edits and request functions over whole tables, and their SQL twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import requests as fr
from caseflow.operators import discovery, slots
from caseflow.plans.common import CELLS_SQL, cells, joined, marked, marked_sql, pick, table
from caseflow.sources import packages, phrases


def _o() -> Column:
    return F.col("o_orderkey")



#: What stands for a frequent word of the documents, so that their lines are cells of forms.
SEGMENT_MARKS = {" the ": " [ ] ", " de ": " □ ", " und ": " 사업자등록번호 ", " en ": " 년 3월 5일 ", " of ": "(서명 또는 인)"}
INLINE_MARKS = {" the ": " [ ] ", " of ": " (서명 또는 인) ", " de ": " 년 3월 5일부터 ", " und ": " (     )원 ", " la ": " (자격 :      ) "}


def _lines(spark: SparkSession, sf_dir: str, marks: dict[str, str]) -> DataFrame:
    """Every line of every document is a cell."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return lines.select("doc_id", F.lit(0).alias("table_id"), "row", F.lit(0).alias("column"), marked(F.col("line"), marks).alias("text"))


def segment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.segment_fields(_lines(spark, sf_dir, SEGMENT_MARKS)).select("doc_id", F.col("row").cast("long").alias("row"), "kind", F.col("at").cast("long").alias("at"), "anchor")


def inline_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.inline_fields(_lines(spark, sf_dir, INLINE_MARKS)).select("doc_id", F.col("row").cast("long").alias("row"), "kind", F.col("at").cast("long").alias("at"), "label")


def field_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discovery.field_union(cells(spark, sf_dir))
    return found.groupBy("kind", "label", "category", "required").agg(F.count("*").alias("n"), F.sum("column").cast("long").alias("columns"))


def unique_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surroundings of the first " the " of every document that has one."""
    at = F.call_function("locate", F.lit(" the "), F.col("text")) - 1
    rows = table(spark, sf_dir, "documents").where(F.contains("text", F.lit(" the ")))
    return rows.select("doc_id", F.md5(discovery.unique_anchor(F.col("text"), at, at + 5)).alias("anchor"))


def apply_typed_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as cells: an edit goes through where its anchor stands as often as it should."""
    text, k = F.coalesce("text", F.lit("")), (F.col("conv_id") + F.col("turn")) % 6
    words, none = F.split(text, " "), F.lit(None).cast("array<string>")
    day = F.concat(F.lit("2026-03-"), (F.length(text) % 33).cast("string"))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", pick(["write_character_grid", "set_date_segments", "set_checkbox", "set_amount", "replace_text_range", "odd"], k).alias("operation"), F.when(k == 0, words[0]).when(k == 1, day).otherwise("5").alias("new_value"),
        F.when(k == 0, F.array_repeat(F.lit(""), 4)).when(k == 1, F.slice(words, 1, 3)).otherwise(F.array(text)).alias("texts_before"),
        F.when(k == 2, " de ").when(k == 3, ".").when(k == 4, "the").alias("anchor"), F.lit(None).cast("string").alias("token"), F.when(k == 3, "prefix_unit").alias("mode"), F.when(k == 1, F.array(F.lit("e"), F.lit("n"), F.lit("i"))).otherwise(none).alias("anchors"),
        none.alias("separators"), F.when(k == 3, 2).otherwise(1).alias("expected_count"),
    )
    return discovery.apply_typed_op(rows).select("conv_id", "turn", F.array_join("texts", "|").alias("texts"), "error")


#: What stands for a sentence's end in turns of even and of odd number.
NAME_MARKS = "의 ", " 서류 "


def target_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as instructions: their first sentence is the name."""
    text = F.replace("text", F.lit("."), pick(list(NAME_MARKS), F.col("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(fr.target_name(text)).alias("name"))


def english_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("o_orderdate").cast("string")
    hours = F.when(_o() % 2 == 0, F.concat(F.lit("9시 0분 ~ 18시 "), day, F.lit("분"))).otherwise(F.col("o_orderpriority"))
    wage = F.when(_o() % 3 != 0, F.concat(_o().cast("string"), F.lit("원, 수습 "), day, F.lit("원"))).otherwise(F.concat(day, F.lit("원")))
    paid = F.when(_o() % 4 != 0, F.concat(F.lit("매월 ("), day, F.lit(")일 또는 매주 ( 금 )요일"))).otherwise("매월")
    return table(spark, sf_dir, "orders").select(_o(), fr.english_working_hours(hours).alias("hours"), fr.english_probation_wage(wage).alias("wage"), fr.english_payment_date(paid).alias("paid"))


def request_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases, routes, glossaries and aliases by order."""
    intent, workflow = F.when(_o() % 2 == 0, "A"), F.when(_o() % 5 != 0, "W")
    outcome = fr.route_outcome(pick(["ask_hr", "ask_worker", "ocr", "out_of_scope"], _o()), F.when(_o() % 3 == 0, "text"))
    glossary = fr.approved_dictionary(pick(["approved", "draft"], _o()), F.when(_o() % 3 != 0, "me"), F.when(_o() % 5 != 0, "2026-01-02"), F.lit("ab"), pick(["AB ", "ab", "cd"], _o()))
    alias = fr.alias_coalesce(F.create_map(F.lit("workflowId"), F.col("o_orderstatus"), F.lit("workflow_id"), F.when(_o() % 2 == 0, "").otherwise("w")), "workflow_id", "workflowId")
    return table(spark, sf_dir, "orders").select(_o(), fr.phase_contract(pick(["PLAN", "ANALYZE", "odd"], _o()), intent, workflow).alias("phase_error"), outcome["status"].alias("status"), outcome["outcome"].alias("outcome"), outcome["review"].alias("review"), glossary.alias("glossary_error"), alias.alias("workflow"))


def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The props of events as replies: fenced, broken or without a field."""
    e = F.col("event_id")
    reply = F.when(e % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(e % 4 == 1, F.col("props")).when(e % 4 == 2, F.lit('{"x": 1}')).otherwise(F.concat("props", F.lit(" and more")))
    parsed = fr.parse_json_reply(reply, "k int")
    return table(spark, sf_dir, "events").select(e, parsed["value"]["k"].cast("long").alias("k"), parsed["error"].alias("error"))


def analyze_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        _o().alias("request_id"), pick(["PLAN", "ANALYZE"], _o()).alias("phase"), F.when(_o() % 7 == 0, "OUT_OF_SCOPE").otherwise("DOCUMENT_REQUEST").alias("intent"), F.array(F.lit("worker_id"), F.lit("wage")).alias("required_slots"),
        F.when(_o() % 3 == 0, F.lit(None).cast("map<string,string>")).when(_o() % 3 == 1, F.create_map(F.lit("worker_id"), F.lit("1"))).otherwise(F.create_map(F.lit("worker_id"), F.lit("1"), F.lit("wage"), F.lit("2"))).alias("slots"),
    )
    return slots.analyze_phase(rows).select("request_id", "status", joined("keys").alias("keys"))


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as zipped forms: a paragraph for each line and a table of language and source; some lack a part, some are no packages."""

    @F.pandas_udf("binary")
    def zipped(ids: pd.Series, texts: pd.Series, langs: pd.Series, sources: pd.Series) -> pd.Series:
        import io
        import zipfile
        from xml.sax.saxutils import escape

        out = []
        for i, text, lang, source in zip(ids, texts, langs, sources, strict=True):
            if i % 7 == 0:
                out.append(text.encode())
                continue
            body = "".join(f"<p><t>{escape(line)}</t></p>" for line in text.split("\n"))
            table_of = "".join(f'<tc><cellAddr rowAddr="2" colAddr="{k}"/><t>{escape(v)}</t></tc>' for k, v in enumerate((lang, source)))
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as archive:
                for name, data in (("mimetype", "application/hwp+zip"), ("Contents/content.hpf", "<x/>"), ("Contents/header.xml", "<x/>"), ("Contents/section0.xml", f'<s xmlns="urn:s">{body}<tbl><tr>{table_of}</tr></tbl></s>')):
                    if not (name == "mimetype" and i % 5 == 0):
                        archive.writestr(name, data)
            out.append(buffer.getvalue())
        return pd.Series(out, dtype="object")

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), zipped("doc_id", "text", "lang", "source").alias("content"))


def package_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packages.extract_package_tables(_packages(spark, sf_dir))
    is_cell = F.col("kind") == "cell"
    return rows.groupBy("path").agg(F.count_if(~is_cell).alias("n_paragraphs"), F.count_if(is_cell).alias("n_cells"), F.sum(F.length("text")).alias("letters"), F.max(F.when(is_cell, F.col("row_addr"))).cast("long").alias("row_addr"), F.max_by("text", F.when(is_cell, F.col("column"))).alias("last_cell"))


def package_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.validate_packages(_packages(spark, sf_dir)).select("path", "valid", joined("errors").alias("errors"), F.col("fingerprint").isNotNull().alias("has_print"))


def package_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packages(spark, sf_dir).select("path", phrases.detect_format(F.col("content")).alias("format"))


def layout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of one layout: those with the same number of lines, whatever their words."""
    prints = packages.validate_packages(_packages(spark, sf_dir)).where("valid")
    return prints.groupBy("fingerprint").agg(F.min(F.col("path").cast("long")).alias("first_doc"), F.count("*").alias("n")).select("first_doc", "n")


QUERIES = {f.__name__: f for f in (package_tables, package_checks, package_formats, layout_groups, segment_fields, inline_fields, field_union, unique_anchor, apply_typed_op, target_name, english_terms, request_contracts, parse_replies, analyze_phase)}


_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _re(pattern: str) -> str:
    """A pattern without the flag for Unicode classes, which means something else there."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


def _lines_sql(marks: dict[str, str]) -> str:
    return f"""l as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null), c0 as (select doc_id, unnest(range(len(l))) as "row", unnest(l) as line from l), c as (select doc_id, "row", {marked_sql('line', marks)} as text from c0)"""


def _spots_sql(kind: str, pattern: str, label: str) -> str:
    """Every match of a pattern with its place: what the gaps and matches before it measure."""
    cut = f"select doc_id, \"row\", string_split_regex(text, '{_re(pattern)}') as g, regexp_extract_all(text, '{_re(pattern)}') as m from c"
    return f"select doc_id, \"row\", '{kind}' as kind, (length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')))::bigint as \"at\", {label} as label from (select *, unnest(generate_series(1, len(m))) as i from ({cut}))"


def _one_sql(kind: str, rule: str, label: str, source: str = "c") -> str:
    return f"select doc_id, \"row\", '{kind}', 0::bigint, {label} from {source} where {rule}"


_trim = lambda x: f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_named = lambda p: f"[x for x in [{_trim(f"""regexp_replace({_trim('y')}, '^,+|,+$', '', 'g')""")} for y in regexp_extract_all(text, '{p}', 1)] if x != '']"
_BEFORE, _AFTER = r"([가-힣A-Za-z][^\[\]]*?)\s*\[\s*\]", r"\[\s*\]\s*([가-힣A-Za-z][^\[\]]*)"
_SEGMENT_SQL = f"""with {_lines_sql(SEGMENT_MARKS)}, f as ({_spots_sql('checkbox', discovery.SEGMENT_BOX, 'm[i]')} union all {_one_sql('date', f"regexp_matches(text, '{_re(discovery.SEGMENT_DATE)}')", f"regexp_extract(text, '{_re(discovery.SEGMENT_DATE)}')")}
  union all {_one_sql('signature', f"regexp_matches(text, '{_re(discovery.SEGMENT_SIGN)}')", f"regexp_extract(text, '{_re(discovery.SEGMENT_SIGN)}')")} union all {_one_sql('number', ' or '.join(f"contains(text, '{w}')" for w in discovery.NUMBER_WORDS), "'사업자등록번호'")}) select doc_id, "row", kind, "at", label as anchor from f"""
_INLINE_SQL = f"""with {_lines_sql(INLINE_MARKS)}, b0 as (select *, {_named(_BEFORE)} as before, {_named(_AFTER)} as after from c where regexp_matches(text, '{_re(discovery.BOX)}')), b as (select *, case when len(before) >= len(after) or len(after) = 0 then before else after end as names, substr({_trim(f"regexp_replace(text, '{_re(discovery.BOX)}', '', 'g')")}, 1, 60) as bare from b0),
  f as ({_spots_sql('date_inline', discovery.INLINE_DATE, "'날짜 입력 영역'")} union all {_spots_sql('signable', discovery.SIGNABLE, 'm[i]')} union all {_spots_sql('amount', discovery.AMOUNT, "'금액 입력 영역'")} union all {_one_sql('checkbox_group', 'len(names) > 1', "array_to_string(names[1:4], ' / ')", 'b')}
  union all {_one_sql('checkbox', "len(names) = 1 or (len(names) = 0 and bare != '')", 'coalesce(names[1], bare)', 'b')} union all {_one_sql('placeholder', f"regexp_matches(text, '{_re(discovery.PLACEHOLDER)}')", _trim(f"regexp_extract(text, '{_re(discovery.PLACEHOLDER)}', 1)"))}) select * from f"""
_TYPED_SQL = """with o as (select conv_id, turn, coalesce(text, '') as t, (conv_id + turn) % 6 as k, string_split(coalesce(text, ''), ' ') as w, '2026-03-' || (length(coalesce(text, '')) % 33)::varchar as day from conversations),
  n as (select *, case k when 2 then ' de ' when 3 then '.' when 4 then 'the' end as a from o), e as (select *, length(w[1]) as letters, len(w[1:3]) as segments, (length(t) - length(replace(t, a, ''))) / length(a) as times,
    len([i for i in [1, 2, 3] if length(w[i]) - length(replace(w[i], ['e', 'n', 'i'][i], '')) != 1]) as odd from n),
  r as (select *, case when k = 0 then case when w[1] = '' or letters > 10000 then 'VALUE_LENGTH' when letters != 4 then 'GRID_LENGTH' end when k = 1 then case when segments = 2 then 'DATE_SEGMENTS' when segments = 1 then 'DATE_MODE' when odd > 0 then 'ANCHOR_COUNT' end when k in (2, 4) and times != 1 or k = 3 and times != 2 then 'ANCHOR_COUNT' when k = 5 then 'UNSUPPORTED_OPERATION' end as error from e)
  select conv_id, turn, case k when 0 then case when error is null then array_to_string([substr(w[1], i, 1) for i in [1, 2, 3, 4]], '|') else '|||' end when 1 then case when error is null then replace(w[1], 'e', '2026') || '|' || replace(w[2], 'n', '03') || '|' || replace(w[3], 'i', day[9:]) else array_to_string(w[1:3], '|') end
    else case when error is not null then t when k = 2 then replace(t, a, '[V]') when k = 3 then replace(t, a, '5 .') else replace(t, a, '5') end end as texts, error from r"""
_TARGET_SQL = rf"""with t as (select conv_id, turn, regexp_replace(replace(text, '.', case when turn % 2 = 0 then '{NAME_MARKS[0]}' else '{NAME_MARKS[1]}' end), ',\s*[A-Z][A-Z0-9_]+\s*$', '') as t from conversations), w as (select *, [x for x in string_split_regex(t, '{_SPACE}+') if x != ''] as w from t),
  i as (select *, coalesce(list_min([i for i in range(1, len(w) + 1) if w[i][-1:] = '의' or starts_with(w[i], '서류')]), len(w) + 1) as i from w)
  select conv_id, turn, md5(case when n = '' or n is null then 'unknown' else n end) as name from (select conv_id, turn, array_to_string([x for x in w[1:i - 1] || [case when w[i][-1:] = '의' then w[i][:-2] else '' end] if x != ''], ' ') as n from i)"""
ORACLE_SQL = {
    "package_tables": "select doc_id::varchar as path, len(string_split(text, chr(10))) as n_paragraphs, 2 as n_cells, (length(replace(text, chr(10), '')) + length(lang) + length(source))::bigint as letters, 2 as row_addr, source as last_cell from documents where doc_id % 7 != 0 and doc_id % 5 != 0",
    "package_checks": "select doc_id::varchar as path, doc_id % 7 != 0 and doc_id % 5 != 0 as valid, case when doc_id % 7 = 0 then 'NOT_A_PACKAGE' when doc_id % 5 = 0 then 'PART_MISSING:mimetype' else '' end as errors, doc_id % 7 != 0 and doc_id % 5 != 0 as has_print from documents",
    "package_formats": "select doc_id::varchar as path, case when doc_id % 7 = 0 or doc_id % 5 = 0 then 'UNKNOWN' else 'ZIP_PACKAGE' end as format from documents",
    "layout_groups": "select min(doc_id) as first_doc, count(*) as n from documents where doc_id % 7 != 0 and doc_id % 5 != 0 group by len(string_split(text, chr(10)))",
    "segment_fields": _SEGMENT_SQL,
    "inline_fields": _INLINE_SQL,
    "field_union": f"""with {CELLS_SQL}, off as (select doc_id, min("row") as sr from cells where text = '결재' group by 1), c as (select cells.* from cells left join off using (doc_id) where sr is null or "row" < sr),
g0 as (select *, row_number() over w - sum((text = '')::int) over w as island, last_value(case when text != '' then text end ignore nulls) over w as lab from c window w as (partition by doc_id, "row" order by "column")),
g as (select doc_id, "row", min("column") as "column", any_value(lab) as label, count(*) as n from g0 where text = '' group by doc_id, "row", island having count(*) >= 4),
d0 as (select doc_id, "row", min(case when contains(text, 'yyyy') then "column" end) as y, min(case when contains(text, 'mm') then "column" end) as m, min(case when contains(text, 'dd') then "column" end) as d from c group by 1, 2), d as (select * from d0 where y is not null and m is not null and d is not null),
u0 as (select *, last_value(case when text != '' then text end ignore nulls) over (partition by doc_id, "row" order by "column" rows between unbounded preceding and 1 preceding) as lab, lead(text) over (partition by doc_id, "row" order by "column") as nt, lead("column") over (partition by doc_id, "row" order by "column") as nc from c),
every as (select doc_id, "row", "column", 'character_grid' as kind, label, 0 as p from g union all select doc_id, "row", y, 'date_segments', '날짜', 1 from d union all select doc_id, "row", "column", 'amount_unit', coalesce(lab, '금액'), 2 from u0 where text = '원' union all select doc_id, "row", nc, 'blank', text, 9 from u0 where text != '' and nt = ''),
taken as (select doc_id, "row", unnest(range("column", "column" + n)) as "column", 0 as by_ from g union all select doc_id, "row", unnest([y, m, d]), 1 from d), t as (select doc_id, "row", "column", min(by_) as by_ from taken group by 1, 2, 3),
k as (select every.* from every left join t using (doc_id, "row", "column") where by_ is null or p <= by_ qualify row_number() over (partition by doc_id, "row", "column" order by p) = 1)
select kind, label, case when "row" <= 12 then 'step1_application' else 'step2_personal' end as category, true as required, count(*) as n, sum("column")::bigint as columns from k group by all""",
    "apply_typed_op": _TYPED_SQL,
    "target_name": _TARGET_SQL,
    "english_terms": "with o as (select o_orderkey as k, day(o_orderdate) as d, o_orderpriority as p from orders) select k as o_orderkey, case when k % 2 = 0 then 'from (09:00) to (18:' || lpad(d::varchar, 2, '0') || ')' else p end as hours, case when k % 3 != 0 then k || ' won, but for up to the first 3 months of probation period: ' || d || ' won' else d || '원' end as wage, case when k % 4 != 0 then 'Every (' || d || ')th day of the month or every (Friday) day of the week. If the payment date falls on a holiday, the payment will be made on the day before the holiday.' else '매월' end as paid from o",
    "request_contracts": """with o as (select o_orderkey as k, o_orderstatus as s from orders) select k as o_orderkey, case k % 3 when 0 then case when k % 2 = 0 or k % 5 != 0 then 'PLAN_WITH_DECISION' end when 1 then case when k % 2 != 0 or k % 5 = 0 then 'ANALYZE_WITHOUT_DECISION' end else 'UNKNOWN_PHASE' end as phase_error,
  case k % 4 when 0 then 'NEEDS_INFO' when 1 then case when k % 3 = 0 then 'WAITING_WORKER' else 'READY_FOR_REVIEW' end when 2 then 'DRAFT' else 'CANCELLED' end as status, case k % 4 when 0 then 'NEEDS_INFO' when 1 then case when k % 3 = 0 then 'WAITING_WORKER' else 'REVIEW_REQUIRED' end when 2 then 'OCR_SAVED' else 'OUT_OF_SCOPE' end as outcome, k % 4 = 1 and k % 3 != 0 as review,
  case when k % 3 = 2 then 'CHECKSUM_MISMATCH' when k % 2 = 1 then 'NOT_APPROVED' when k % 3 = 0 then 'REVIEWER_MISSING' when k % 5 = 0 then 'REVIEW_DATE_INVALID' end as glossary_error, case when k % 2 = 0 then s else 'w' end as workflow from o""",
    "parse_replies": "select event_id, case when event_id % 4 < 2 then json_extract(props, '$.k')::bigint end as k, case when event_id % 4 >= 2 then 'INVALID_REPLY' end as error from events",
    "analyze_phase": "with o as (select o_orderkey as k, o_orderkey % 2 = 0 as plan, o_orderkey % 7 = 0 as outside, o_orderkey % 3 as s from orders) select k as request_id, case when outside then 'OUT_OF_SCOPE' when plan then 'PLANNED' when s = 0 then 'NO_WORKER' when s = 1 then 'NEEDS_INFO' else 'CANDIDATE' end as status, case when outside then '' when plan then 'worker_id,wage' when s = 0 then '' when s = 1 then 'wage' else '' end as keys from o",
}
