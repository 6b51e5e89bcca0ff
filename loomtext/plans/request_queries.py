"""Queries over requests. The texts are made from columns of the tables and from phrases in Korean and English, chosen by a row's key; their SQL
applies the rules to the same texts (the phrases' answers stand in the tests)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import requests as Q

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def take(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return take


def turns(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")


def made(spark, sf, table: str, columns: str, **texts: str):
    """The table with texts that the same expressions make in both engines."""
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    return df.selectExpr(*columns.split(", "), *[f"{e} AS {n}" for n, e in texts.items()])


def _chosen(phrases: list[str], key: str) -> str:
    """An expression of both engines: the phrase by the key's remainder."""
    whens = " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(phrases))
    return f"CASE {key} % {len(phrases)} {whens} END"


def _pairs(text: str) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in line.split("=")) + ")" for line in text.split())


_TEXT = "CAST({} AS STRING)"
_DATE = "substr(CAST(o_orderdate AS STRING), {}, {})"
_DAY = _chosen([_DATE.format(1, 10), _DATE.format(6, 5), "' Today '", "o_orderpriority", "'내일'", "'다음주'", "''", "lower(o_orderstatus)"], "o_orderkey")
_CLOCK = _chosen(["concat(lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'))", "concat(CAST(o_orderkey % 30 AS STRING), '시')", "concat('오후 ', CAST(o_orderkey % 12 AS STRING), ' 시')", "concat(CAST(o_orderkey % 13 AS STRING), 'pm')", "concat(CAST(o_orderkey % 13 AS STRING), ' AM')", "CAST(o_orderkey % 40 AS STRING)", "o_orderpriority"], "o_orderkey")
_CITY = _chosen(["'서울'", "'Busan'", "concat('서울시 ', o_orderstatus)", "o_orderpriority", "' daegu '", "'대'", "concat(o_orderstatus, '인천 광주')"], "o_orderkey")
_KIND = _chosen(["'.PDF'", "'이미지'", "'mkv'", "concat('.', o_orderstatus)", "''", "'xlsx'", "' RS '", "'Code'"], "o_orderkey")
_DAYS = _pairs("오늘=today 내일=tomorrow 어제=yesterday 이번주=this_week 다음주=next_week today=today tomorrow=tomorrow yesterday=yesterday")
_CITIES = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(x.split("=") for x in "서울=seoul 부산=busan 인천=incheon 대구=daegu 광주=gwangju seoul=seoul busan=busan incheon=incheon daegu=daegu gwangju=gwangju".split()))
_ENDS = _pairs("pdf=document doc=document docx=document txt=document md=document rtf=document ppt=document pptx=document xls=document xlsx=document jpg=image jpeg=image png=image gif=image bmp=image svg=image tiff=image mp4=video avi=video mov=video mkv=video wmv=video flv=video webm=video py=code js=code html=code css=code java=code cpp=code c=code php=code go=code rs=code swift=code")
_KINDS = _pairs("문서=document 이미지=image 비디오=video 코드=code 기타=other document=document image=image video=video code=code other=other")


@query("a22_normalized", f"""WITH x AS (SELECT o_orderkey, {_DAY} AS d, {_CLOCK} AS t, {_CITY} AS c, {_KIND} AS k FROM orders),
 y AS (SELECT *, lower(trim(d)) AS ld, lower(t) AS lt, lower(trim(c)) AS lc, lower(trim(k)) AS lk, regexp_replace(lower(trim(k)), '^\\.', '') AS e,
  TRY_CAST(nullif(regexp_extract(lower(t), '([0-9]{{1,2}})\\s*시', 1), '') AS INTEGER) AS ko, TRY_CAST(nullif(regexp_extract(lower(t), '([0-9]{{1,2}})\\s*pm', 1), '') AS INTEGER) AS pm,
  TRY_CAST(nullif(regexp_extract(lower(t), '([0-9]{{1,2}})\\s*am', 1), '') AS INTEGER) AS am, TRY_CAST(nullif(regexp_extract(lower(t), '^([0-9]{{1,2}})$', 1), '') AS INTEGER) AS h FROM x)
 SELECT o_orderkey,
  coalesce((SELECT v FROM (VALUES {_DAYS}) a(n, v) WHERE n = ld), CASE WHEN regexp_matches(ld, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN ld WHEN regexp_matches(ld, '^[0-9]{{2}}-[0-9]{{2}}') THEN '2025-' || ld ELSE 'today' END) AS day,
  CASE WHEN regexp_matches(t, '^[0-9]{{2}}:[0-9]{{2}}') THEN t WHEN ko IS NOT NULL THEN lpad(ko::VARCHAR, 2, '0') || ':00' WHEN pm IS NOT NULL THEN lpad((CASE WHEN pm = 12 THEN 12 ELSE pm + 12 END)::VARCHAR, 2, '0') || ':00'
   WHEN am IS NOT NULL THEN lpad((am % 12)::VARCHAR, 2, '0') || ':00' WHEN h BETWEEN 0 AND 23 THEN lpad(h::VARCHAR, 2, '0') || ':00' ELSE '09:00' END AS clock,
  coalesce((SELECT v FROM (VALUES {_CITIES}) a(i, n, v) WHERE n = lc), (SELECT arg_min(v, i) FROM (VALUES {_CITIES}) a(i, n, v) WHERE contains(c, n) OR contains(n, c)), lc) AS city,
  coalesce((SELECT v FROM (VALUES {_KINDS}) a(n, v) WHERE n = lk), (SELECT v FROM (VALUES {_ENDS}) a(n, v) WHERE n = e), 'other') AS kind FROM y""")
def a22(spark, sf):
    x = made(spark, sf, "orders", "o_orderkey", d=_DAY, t=_CLOCK, c=_CITY, k=_KIND)
    return x.select("o_orderkey", Q.day(F.col("d"), F.lit(2025)).alias("day"), Q.clock(F.col("t")).alias("clock"), Q.city(F.col("c")).alias("city"), Q.file_kind(F.col("k")).alias("kind"))


_ASKED = _chosen(["concat(substr(text, 1, 30), ' 문서 찾아줘')", "'이 파일 보여줘'", "concat('README ', substr(text, 1, 20))", "concat('API 명세서 검색 ', role)", "substr(text, 1, 60)", "concat(role, ' 설정')", "concat('프로젝트 자료 알려줘 ', role)"], "(conv_id + turn)")
_GOOD = "list_filter(list_transform(regexp_extract_all(t, '{}', 1), lambda x: trim(x)), lambda x: length(x) > 1 AND x NOT IN ('이', '그', '저', '것', '거'))[1]"
_FILES = "'프로젝트', '문서', 'api', '명세서', '회의록', '보고서', '계획서', '가이드', '매뉴얼', 'readme', '코드', '파일', '데이터', '스크립트', '이미지', '사진', '영상', '비디오', '음악', '소스', '설정', 'config'"


@query("a23_search_words", f"""WITH x AS (SELECT conv_id, turn, {_ASKED} AS t FROM conversations) SELECT conv_id, turn, coalesce({_GOOD.format('(.+?)\\s*(?:문서|파일)')}, {_GOOD.format('(.+?)\\s*(?:찾아|검색)')}, {_GOOD.format('(.+?)\\s*(?:보여|알려)')},
 list_filter([{_FILES}], lambda w: contains(lower(t), w))[1], '') AS words FROM x""")
def a23(spark, sf):
    return made(spark, sf, "conversations", "conv_id, turn", t=_ASKED).select("conv_id", "turn", Q.search_words(F.col("t")).alias("words"))


_REQUEST = f"concat({_chosen(["'오늘 서울 날씨 '", "'회의 일정 잡아줘 '", "'부산 기온을 이메일로 보내줘 '", "''", "'보고서 file '", "'슬랙 '", "'대구 인천 비 확인 '", "'강릉 sms 전송 '"], 'turn')}, text)"


@query("a19_intents", f"""WITH r AS (SELECT conv_id, turn, {_REQUEST} AS t, lower({_REQUEST}) AS l FROM conversations),
 f AS (SELECT *, list_filter([CASE WHEN regexp_matches(l, '날씨|기온|비|눈|바람|온도|weather') THEN 'weather' END, CASE WHEN regexp_matches(l, '일정|회의|약속|미팅|스케줄|schedule|meeting') THEN 'calendar' END,
  CASE WHEN regexp_matches(l, '파일|문서|자료|보고서|데이터|file|document') THEN 'file' END, CASE WHEN regexp_matches(l, '알림|알려|보내|전송|메시지|이메일|슬랙|notification') THEN 'notification' END], lambda x: x IS NOT NULL) AS found FROM r)
 SELECT conv_id, turn, CASE WHEN len(found) > 1 THEN array_to_string(found, '_and_') WHEN len(found) = 1 THEN found[1] || '_query' ELSE 'general_conversation' END AS intent,
 CASE WHEN contains(t, '서울') THEN '서울' WHEN contains(t, '부산') THEN '부산' WHEN contains(t, '대구') THEN '대구' WHEN contains(t, '인천') THEN '인천' WHEN contains(t, '강릉') THEN '강릉' WHEN list_contains(found, 'weather') THEN '서울' END AS city,
 CASE WHEN regexp_matches(l, '이메일|email') THEN 'email' WHEN regexp_matches(l, '슬랙|slack') THEN 'slack' WHEN regexp_matches(l, '문자|sms') THEN 'sms' END AS channel,
 CASE WHEN regexp_matches(t, '확인|조회|알려') THEN 'query' WHEN regexp_matches(t, '생성|만들|잡아') THEN 'create' WHEN regexp_matches(t, '보내|전송') THEN 'send' END AS action FROM f""")
def a19(spark, sf):
    t = F.col("t")
    return made(spark, sf, "conversations", "conv_id, turn", t=_REQUEST).select("conv_id", "turn", Q.intent(t).alias("intent"), Q.intent_parameters(t).alias("p")).select("conv_id", "turn", "intent", "p.*")


_POINT = "CAST(o_orderkey % {} AS STRING)"
_ITEMS = f"concat('구조/논리: ', {_POINT.format(3)}, '/2점 정량 데이터: 1.5/2 구체적 도구/기술: ', {_POINT.format(2)}, '/2 실제 사례: 0.5/2 전문성 / 깊이: 1/2 **품질 점수:** 9')"
_REVIEW = _chosen([_ITEMS, f"concat('**품질 점수**: ', {_POINT.format(12)})", f"concat('품질 점수: **', {_POINT.format(9)}, '.5**')", f"concat('품질 점수: ', {_POINT.format(50)})", "o_orderpriority", f"concat('구조/논리: 2/2 품질 점수 : ', {_POINT.format(8)})"], "o_orderkey")
_SUM = " + ".join(f"TRY_CAST(nullif(regexp_extract(t, '(?i){p}\\s*:\\s*([0-9]+(?:\\.[0-9]+)?)\\s*/\\s*2', 1), '') AS DOUBLE)" for p in ["구조\\s*/?\\s*논리", "정량\\s*데이터", "구체적\\s*도구\\s*/?\\s*기술", "실제\\s*사례", "전문성\\s*/?\\s*깊이"])
_SAID = [f"TRY_CAST(nullif(regexp_extract(t, '{p}([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE)" for p in ["\\*\\*품질\\s*점수:\\*\\*\\s*", "\\*\\*품질\\s*점수\\*\\*\\s*:\\s*", "품질\\s*점수\\s*:\\s*", "품질\\s*점수\\s*:\\s*\\*\\*"]]


@query("a25_rubric", f"WITH x AS (SELECT o_orderkey, {_REVIEW} AS t FROM orders) SELECT o_orderkey, coalesce({_SUM}, {', '.join(f'CASE WHEN {s} BETWEEN 1 AND 10 THEN {s} END' for s in _SAID)}, 3.0)::DOUBLE AS score FROM x")
def a25(spark, sf):
    return made(spark, sf, "orders", "o_orderkey", t=_REVIEW).select("o_orderkey", Q.rubric_score(F.col("t"), F.lit(3.0)).alias("score"))


@query("a25_stop_rule", """WITH s AS (SELECT user_id, event_id, row_number() OVER w AS iteration, round(value / 10, 1) AS score, lag(round(value / 10, 1)) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT user_id, event_id, CASE WHEN score >= 8 THEN 'threshold' WHEN iteration >= 5 THEN 'maximum' WHEN score < previous THEN 'regress' WHEN iteration >= 2 AND score - previous < 0.5 THEN 'plateau' END AS reason FROM s""")
def a25_stop(spark, sf):
    """A user's events as iterations of a loop, their values as scores."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.round(F.col("value") / 10, 1).alias("score"))
    return s.select("user_id", "event_id", Q.stop_reason(F.row_number().over(w), F.col("score"), F.lag("score").over(w)).alias("reason"))


AGENTS = ["tech", "business", "general"]
_ONE, _TWO = "CAST(o_orderkey % 10 AS STRING)", "CAST(o_orderkey % 7 AS STRING)"
_BOTH = f"concat('{{{{\"scores\": {{{{\"tech\": {{{{\"score\": 0.', {_ONE}, '}}}}, \"business\": {{{{\"score\": 0.', {_TWO}, '}}}}}}}}}}}}')".replace("{{", "{").replace("}}", "}")
_FENCE = "```"
_ROUTE = _chosen([_BOTH, f"concat('Here: {_FENCE}json ', {_BOTH}, ' {_FENCE}')", "'no json'", f"concat('{_FENCE} ', {_BOTH}, ' {_FENCE} done')", "o_orderpriority", "'{\"scores\": {}}'"], "o_orderkey")


@query("a25_router", f"""WITH x AS (SELECT o_orderkey, {_ROUTE} AS t FROM orders), b AS (SELECT o_orderkey, coalesce(nullif(regexp_extract(t, '(?s){_FENCE}(?:json)?(.*?){_FENCE}', 1), ''), t) AS j FROM x),
 v AS (SELECT o_orderkey, CASE WHEN json_valid(j) THEN j ELSE '{{}}' END AS j FROM b),
 s AS (SELECT o_orderkey, json_extract(j, '$.scores') IS NOT NULL AS readable, {', '.join(f"TRY_CAST(json_extract_string(j, '$.scores.{a}.score') AS DOUBLE) AS {a}" for a in AGENTS)} FROM v),
 m AS (SELECT *, greatest(coalesce(tech, 0), coalesce(business, 0), coalesce("general", 0)) AS best FROM s)
 SELECT o_orderkey, CASE WHEN best > 0 AND tech = best THEN 'tech' WHEN best > 0 AND business = best THEN 'business' ELSE 'general' END AS agent, CASE WHEN readable THEN best ELSE 0.5 END::DOUBLE AS confidence FROM m""")
def a25c(spark, sf):
    return made(spark, sf, "orders", "o_orderkey", t=_ROUTE).select("o_orderkey", Q.routed(F.col("t"), AGENTS).alias("r")).select("o_orderkey", "r.*")


_JUDGED = _chosen(["concat('Sure: {\"score\": 0.', CAST(event_id % 10 AS STRING), ', \"explanation\": \"', event_type, '\"} done')", "concat('{broken ', event_type)", "props", "concat('{\"score\": \"', CAST(event_id % 4 AS STRING), '\"}')", "event_type", "concat('{\"score\": \"', event_type, '\"}')"], "event_id")


@query("e3_judged", f"""WITH x AS (SELECT event_id, regexp_extract({_JUDGED}, '(?s)\\{{.*\\}}') AS j FROM events) SELECT event_id, coalesce(CASE WHEN json_valid(j) THEN TRY_CAST(json_extract_string(j, '$.score') AS DOUBLE) END, 0.5)::DOUBLE AS score FROM x""")
def e3(spark, sf):
    return made(spark, sf, "events", "event_id", t=_JUDGED).select("event_id", Q.judged_score(F.col("t")).alias("score"))


_CHANNEL = _chosen(["'Slack'", "'문자'", "concat('사내 이메일 ', event_type)", "''", "event_type", "'팀'"], "event_id")
_PRIORITY = _chosen(["'긴급'", "'HIGH'", "event_type", "''", "' 낮음 '"], "event_id")
_NOTICE = _chosen(["'경고'", "'Task'", "event_type", "'오류'"], "event_id")
_API = _chosen(["'Weather API'", "'날씨_api'", "'문서 검색'", "'FILE_API'", "concat(event_type, ' api')", "event_type"], "event_id")
_CHANNELS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(x.split("=") for x in "슬랙=slack 이메일=email 문자=sms 팀즈=teams slack=slack email=email sms=sms teams=teams".split()))
_PRIORITIES = _pairs("높음=high 보통=normal 낮음=low 긴급=urgent high=high normal=normal low=low urgent=urgent")
_NOTICES = _pairs("정보=info 경고=warning 오류=error 성공=success 작업=task info=info warning=warning error=error success=success task=task")
_APIS = "('weather', 'weather'), ('날씨', 'weather'), ('calendar', 'calendar'), ('일정', 'calendar'), ('스케줄', 'calendar'), ('file', 'file'), ('file manager', 'file'), ('파일', 'file'), ('문서', 'file'), ('문서 검색', 'file'), ('파일 검색', 'file'), ('notification', 'notification'), ('알림', 'notification'), ('메시지', 'notification')"


@query("z10_aliases", f"""WITH x AS (SELECT event_id, {_CHANNEL} AS c, {_PRIORITY} AS p, {_NOTICE} AS k, {_API} AS a FROM events)
 SELECT event_id, CASE WHEN trim(c) = '' THEN 'slack' ELSE coalesce((SELECT v FROM (VALUES {_CHANNELS}) y(i, n, v) WHERE n = lower(trim(c))), (SELECT arg_min(v, i) FROM (VALUES {_CHANNELS}) y(i, n, v) WHERE contains(c, n) OR contains(n, c)), 'slack') END AS channel,
 coalesce((SELECT v FROM (VALUES {_PRIORITIES}) y(n, v) WHERE n = lower(trim(p))), 'normal') AS priority, coalesce((SELECT v FROM (VALUES {_NOTICES}) y(n, v) WHERE n = lower(trim(k))), 'info') AS kind,
 coalesce((SELECT v FROM (VALUES {_APIS}) y(n, v) WHERE n = replace(regexp_replace(lower(a), '[ _]api$', ''), '_', ' ')), lower(a)) AS api FROM x""")
def z10(spark, sf):
    x = made(spark, sf, "events", "event_id", c=_CHANNEL, p=_PRIORITY, k=_NOTICE, a=_API)
    named = [Q.alias(F.col("c"), Q.CHANNELS, "slack", partial=True).alias("channel"), Q.alias(F.col("p"), Q.PRIORITIES, "normal").alias("priority"), Q.alias(F.col("k"), Q.NOTICES, "info").alias("kind"), Q.api(F.col("a")).alias("api")]
    return x.select("event_id", *named)


_SENT = f"concat({_chosen(["'팀에게 메일로 '", "'문자 부탁 '", "'slack에 '", "''", "'SMS로 '", "'전화로 email에 '", "'휴대폰으로 이메일 '"], '(conv_id + turn)')}, text)"


@query("z11_channels", f"""WITH x AS (SELECT conv_id, turn, lower({_SENT}) AS l FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(l, '메일로|email로|메일에|이메일|메일') THEN 'email'
 WHEN regexp_matches(l, 'sms로|문자|휴대폰으로|전화로|핸드폰으로') THEN 'sms' ELSE 'slack' END AS channel FROM x""")
def z11(spark, sf):
    return made(spark, sf, "conversations", "conv_id, turn", t=_SENT).select("conv_id", "turn", Q.channel_in(F.col("t")).alias("channel"))


@query("z12_summaries", "SELECT doc_id, '현재 맑음, ' || (doc_id % 40) || '도' AS weather, md5(CASE WHEN length(text) > CASE WHEN contains(text, 'the') THEN 100 ELSE 50 END THEN substr(text, 1, CASE WHEN contains(text, 'the') THEN 100 ELSE 50 END) || '...' ELSE text END) AS summary FROM documents")
def z12(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    info = F.concat(F.lit("지역: 서울\n온도: "), (F.col("doc_id") % 40).cast("string"), F.lit("도\n날씨: 맑음"))
    temperature, sky = Q.key_lines(info, "온도", "날씨")
    return d.select("doc_id", F.concat(F.lit("현재 "), sky, F.lit(", "), temperature).alias("weather"), F.md5(Q.summary(F.col("text"), ["the"])).alias("summary"))


_INTENT = _chosen(["concat('weather_', CASE role WHEN 'user' THEN 'query' WHEN 'assistant' THEN 'forecast' ELSE 'create' END)", "concat('calendar_', CASE role WHEN 'user' THEN 'query' ELSE 'create' END)", "concat('file_', CASE role WHEN 'user' THEN 'query' WHEN 'assistant' THEN 'search' ELSE 'create' END)", "concat('notification_', CASE role WHEN 'user' THEN 'query' WHEN 'assistant' THEN 'send' ELSE 'create' END)", "role"], "(conv_id + turn)")


@query("z20_tools", f"""WITH x AS (SELECT conv_id, turn, {_INTENT} AS i FROM conversations), t AS (SELECT *, CASE WHEN i IN ('weather_query', 'weather_create') THEN 'get_current_weather' WHEN i = 'weather_forecast' THEN 'get_weather_forecast' WHEN i = 'calendar_query' THEN 'get_today_schedule'
 WHEN i = 'calendar_create' THEN 'create_event' WHEN starts_with(i, 'file_') THEN 'search_files' WHEN starts_with(i, 'notification_') THEN 'send_slack_message' END AS tool FROM x) SELECT conv_id, turn, tool, tool IS NOT NULL AS success FROM t""")
def z20(spark, sf):
    i = F.col("i")
    return made(spark, sf, "conversations", "conv_id, turn", i=_INTENT).select("conv_id", "turn", Q.tool(i).alias("tool"), Q.tool(i).isNotNull().alias("success"))
