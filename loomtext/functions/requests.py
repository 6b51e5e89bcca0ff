"""What users ask for, as column expressions: dates, times, places, channels, intents, search words; scores and choices in models' answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that results depend on, in the order in which they are tried.
DAYS = {"오늘": "today", "내일": "tomorrow", "어제": "yesterday", "이번주": "this_week", "다음주": "next_week", "today": "today", "tomorrow": "tomorrow", "yesterday": "yesterday"}
CITIES = {"서울": "seoul", "부산": "busan", "인천": "incheon", "대구": "daegu", "광주": "gwangju", "seoul": "seoul", "busan": "busan", "incheon": "incheon", "daegu": "daegu", "gwangju": "gwangju"}
# Places that a request can name, in the order in which they are tried.
PLACES = """서울 부산 대구 인천 광주 대전 울산 세종 수원 고양 용인 성남 안산 안양 남양주 평택 시흥 김포 하남 오산 구리 군포 의왕 과천 의정부 동두천 안성 포천 여주 양평 가평 연천
춘천 원주 강릉 태백 삼척 정선 속초 고성 양양 인제 횡성 영월 평창 화천 양구 철원 청주 충주 제천 보은 옥천 영동 증평 진천 괴산 음성 단양 천안 공주 보령 아산 서산 논산 계룡 당진 금산
부여 서천 청양 홍성 예산 태안 전주 군산 익산 정읍 남원 김제 완주 진안 무주 장수 임실 순창 고창 부안 목포 여수 순천 나주 광양 담양 곡성 구례 고흥 보성 화순 장흥 강진 해남 영암 무안
함평 영광 장성 완도 진도 신안 포항 경주 김천 안동 구미 영주 영천 상주 문경 경산 군위 의성 청송 영양 영덕 청도 고령 성주 칠곡 예천 봉화 울진 울릉 독도""".split()
CHANNELS = {"슬랙": "slack", "이메일": "email", "문자": "sms", "팀즈": "teams", "slack": "slack", "email": "email", "sms": "sms", "teams": "teams"}
PRIORITIES = {"높음": "high", "보통": "normal", "낮음": "low", "긴급": "urgent", "high": "high", "normal": "normal", "low": "low", "urgent": "urgent"}
NOTICES = {"정보": "info", "경고": "warning", "오류": "error", "성공": "success", "작업": "task", "info": "info", "warning": "warning", "error": "error", "success": "success", "task": "task"}
FILE_KINDS = {"문서": "document", "이미지": "image", "비디오": "video", "코드": "code", "기타": "other", "document": "document", "image": "image", "video": "video", "code": "code", "other": "other"}
EXTENSIONS = {
    "document": ["pdf", "doc", "docx", "txt", "md", "rtf", "ppt", "pptx", "xls", "xlsx"],
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "svg", "tiff"],
    "video": ["mp4", "avi", "mov", "mkv", "wmv", "flv", "webm"],
    "code": ["py", "js", "html", "css", "java", "cpp", "c", "php", "go", "rs", "swift"],
}
APIS = {"weather": ["weather", "날씨"], "calendar": ["calendar", "일정", "스케줄"], "file": ["file", "file manager", "파일", "문서", "문서 검색", "파일 검색"], "notification": ["notification", "알림", "메시지"]}
CHANNEL_WORDS = {
    "email": ["이메일로", "메일로", "email로", "이메일에", "메일에", "이메일", "메일"],
    "sms": ["sms로", "문자로", "휴대폰으로", "전화로", "문자", "핸드폰으로"],
    "slack": ["슬랙에", "슬랙으로", "slack에", "slack으로", "슬랙", "채널에", "팀에게"],
}
INTENTS = {
    "weather": ["날씨", "기온", "비", "눈", "바람", "온도", "weather"],
    "calendar": ["일정", "회의", "약속", "미팅", "스케줄", "schedule", "meeting"],
    "file": ["파일", "문서", "자료", "보고서", "데이터", "file", "document"],
    "notification": ["알림", "알려", "보내", "전송", "메시지", "이메일", "슬랙", "notification"],
}
ACTIONS = {"query": ["확인", "조회", "알려"], "create": ["생성", "만들", "잡아"], "send": ["보내", "전송"]}
TOOLS = {
    "weather_query": "get_current_weather", "weather_forecast": "get_weather_forecast", "weather_create": "get_current_weather",
    "calendar_query": "get_today_schedule", "calendar_create": "create_event",
    "file_query": "search_files", "file_search": "search_files", "file_create": "search_files",
    "notification_query": "send_slack_message", "notification_send": "send_slack_message", "notification_create": "send_slack_message",
}
FILE_WORDS = ["프로젝트", "문서", "api", "명세서", "회의록", "보고서", "계획서", "가이드", "매뉴얼", "readme", "코드", "파일", "데이터", "스크립트", "이미지", "사진", "영상", "비디오", "음악", "소스", "설정", "config"]
FILE_PATTERNS = ["(.+?)\\s*(?:문서|파일)", "(.+?)\\s*(?:찾아|검색)", "(.+?)\\s*(?:보여|알려)"]
DEMONSTRATIVES = ["이", "그", "저", "것", "거"]
RUBRIC = ["구조\\s*/?\\s*논리", "정량\\s*데이터", "구체적\\s*도구\\s*/?\\s*기술", "실제\\s*사례", "전문성\\s*/?\\s*깊이"]
STATED = ["\\*\\*품질\\s*점수:\\*\\*\\s*", "\\*\\*품질\\s*점수\\*\\*\\s*:\\s*", "품질\\s*점수\\s*:\\s*", "품질\\s*점수\\s*:\\s*\\*\\*"]
NUMBER = "([0-9]+(?:\\.[0-9]+)?)"


def _first(choices: list[tuple[Column, Column | str]], last: Column | str) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return reduce(lambda rest, c: F.when(c[0], as_column(c[1])).otherwise(rest), reversed(choices), as_column(last))


def has_any(t: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])


def alias(t: Column, table: dict[str, str], last: Column | str, partial: bool = False) -> Column:
    """The value of the name that t is; with partial, else that of the first name within t, or with t within it; else last (nulls too)."""
    low = F.lower(F.trim(t))
    exact = _first([(low == k, v) for k, v in table.items()], F.lit(None).cast("string"))
    near = _first([(F.contains(t, F.lit(k)) | F.contains(F.lit(k), t), v) for k, v in table.items()], F.lit(None).cast("string"))
    return F.when(F.trim(t) == "", last if isinstance(last, Column) else F.lit(last)).otherwise(F.coalesce(exact, *([near] if partial else []), last if isinstance(last, Column) else F.lit(last)))


def day(t: Column, year: Column) -> Column:
    """A named day, a date as it is, month and day with the year before them; today otherwise."""
    low = F.lower(F.trim(t))
    dates = _first([(low.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), low), (low.rlike("^[0-9]{2}-[0-9]{2}"), F.concat(year.cast("string"), F.lit("-"), low))], "today")
    return alias(t, DAYS, dates)


def clock(t: Column) -> Column:
    """HH:MM from HH:MM, 3시, 3pm, 3am or a plain hour; 09:00 otherwise."""
    low = F.lower(t)
    hour = lambda p: F.try_to_number(F.nullif(F.regexp_extract(low, p, 1), F.lit("")), F.lit("99")).cast("int")
    at = lambda h: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))
    korean, pm, am, plain = hour("([0-9]{1,2})\\s*시"), hour("([0-9]{1,2})\\s*pm"), hour("([0-9]{1,2})\\s*am"), hour("^([0-9]{1,2})$")
    return _first(
        [
            (F.coalesce(t.rlike("^[0-9]{2}:[0-9]{2}"), F.lit(False)), t), (korean.isNotNull(), at(korean)), (pm.isNotNull(), at(F.when(pm == 12, pm).otherwise(pm + 12))),
            (am.isNotNull(), at(F.when(am == 12, 0).otherwise(am))), (plain.between(0, 23), at(plain)),
        ], "09:00",
    )


def city(t: Column) -> Column:
    return alias(t, CITIES, F.lower(F.trim(t)), partial=True)


def file_kind(t: Column) -> Column:
    """A kind by its name or by an extension, with or without its dot; other otherwise."""
    end = F.regexp_replace(F.lower(F.trim(t)), "^\\.", "")
    by_end = _first([(end.isin(v), k) for k, v in EXTENSIONS.items()], "other")
    return F.coalesce(alias(t, FILE_KINDS, by_end), F.lit("other"))


def api(t: Column) -> Column:
    """An interface's short name: its aliases, with or without `api` after them; else the text in lower case."""
    low = F.lower(t)
    base = F.replace(F.regexp_replace(low, "[ _]api$", ""), F.lit("_"), F.lit(" "))
    return _first([(base.isin(v), k) for k, v in APIS.items()], low)


def channel_in(t: Column) -> Column:
    """The channel that a request names: e-mail before text messages before chat, which is also the default."""
    low = F.lower(t)
    return _first([(has_any(low, w), c) for c, w in CHANNEL_WORDS.items()], "slack")


def intent(t: Column) -> Column:
    """Intents whose words a request has: several are joined with _and_, one gets _query after it, none is general_conversation."""
    low = F.lower(t)
    found = F.array_compact(F.array(*[F.when(has_any(low, w), F.lit(i)) for i, w in INTENTS.items()]))
    return F.when(F.size(found) > 1, F.array_join(found, "_and_")).when(F.size(found) == 1, F.concat(found[0], F.lit("_query"))).otherwise("general_conversation")


def intent_parameters(t: Column, cities: list[str] = PLACES) -> Column:
    """struct(city, channel, action). A request about the weather without a city is about the first one."""
    low = F.lower(t)
    within = F.filter(F.array(*[F.lit(c) for c in cities]), lambda c: F.contains(t, c))
    named = F.coalesce(F.get(within, F.lit(0)), F.when(has_any(low, INTENTS["weather"]), F.lit(cities[0])))
    channel = _first([(has_any(low, ["이메일", "email"]), "email"), (has_any(low, ["슬랙", "slack"]), "slack"), (has_any(low, ["문자", "sms"]), "sms")], F.lit(None).cast("string"))
    action = _first([(has_any(t, w), a) for a, w in ACTIONS.items()], F.lit(None).cast("string"))
    return F.struct(named.alias("city"), channel.alias("channel"), action.alias("action"))


def tool(i: Column) -> Column:
    """The tool for an intent; null for unknown ones."""
    return _first([(i == k, v) for k, v in TOOLS.items()], F.lit(None).cast("string"))


def search_words(t: Column) -> Column:
    """What stands before words for files, searching or showing (more than one character, no demonstrative); else the first known file word;
    else nothing."""
    good = lambda w: (F.length(w) > 1) & ~w.isin(DEMONSTRATIVES)
    found = [F.filter(F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda w: F.trim(w)), good) for p in FILE_PATTERNS]
    low = F.lower(t)
    return _first([(F.size(x) > 0, F.get(x, F.lit(0))) for x in found] + [(F.contains(low, F.lit(w)), w) for w in FILE_WORDS], "")


def rubric_score(t: Column, previous: Column | None = None) -> Column:
    """The sum of five items of two points each, where all are given; else a stated score from 1 to 10; else the previous one; else 5."""
    points = [F.nullif(F.regexp_extract(t, f"(?i){p}\\s*:\\s*{NUMBER}\\s*/\\s*2", 1), F.lit("")).cast("double") for p in RUBRIC]
    total = reduce(lambda a, b: a + b, points)
    stated = [F.nullif(F.regexp_extract(t, f"(?i){p}{NUMBER}", 1), F.lit("")).cast("double") for p in STATED]
    return F.coalesce(total, *[F.when(s.between(1, 10), s) for s in stated], *([previous] if previous is not None else []), F.lit(5.0))


def json_part(t: Column) -> Column:
    """From the first opening brace to the last closing one; null without."""
    return F.nullif(F.regexp_extract(t, "(?s)\\{.*\\}", 0), F.lit(""))


def judged_score(t: Column, last: float = 0.5) -> Column:
    """The score within a judge's JSON; last where it is none."""
    return F.coalesce(F.get_json_object(json_part(t), "$.score").try_cast("double"), F.lit(last))


def routed(t: Column, agents: list[str], last: str = "general") -> Column:
    """struct(agent, confidence): the agent with the highest score of `scores` in a fenced JSON answer, the earlier one of equals; without
    readable scores the last resort, at 0.5."""
    body = F.coalesce(F.nullif(F.regexp_extract(t, "(?s)```(?:json)?(.*?)```", 1), F.lit("")), t)
    score = [F.get_json_object(body, f"$.scores.{a}.score").try_cast("double") for a in agents]
    best = F.array_max(F.array(*[F.coalesce(s, F.lit(0.0)) for s in score]))
    agent = _first([(F.coalesce(s == best, F.lit(False)) & (best > 0), a) for s, a in zip(score, agents)], last)
    readable = F.coalesce(F.get_json_object(body, "$.scores"), F.lit("")) != ""
    return F.struct(agent.alias("agent"), F.when(readable, best).otherwise(F.lit(0.5)).alias("confidence"))


def key_lines(t: Column, *names: str) -> list[Column]:
    """What follows `name:` on the first line that has it, for each name; null without."""
    return [F.nullif(F.trim(F.regexp_extract(t, f"(?m){n}:[ \\t]*([^\\n]*)$", 1)), F.lit("")) for n in names]


def summary(t: Column, marks: list[str], short: int = 50, long: int = 100) -> Column:
    """The beginning: longer where the text has one of the marks, with dots where something is left out."""
    n = F.when(has_any(t, marks), F.lit(long)).otherwise(F.lit(short))
    return F.when(F.length(t) > n, F.concat(t.substr(F.lit(1), n), F.lit("..."))).otherwise(t)


def stop_reason(iteration: Column, score: Column, previous: Column, most: int = 5, enough: float = 8.0, least_gain: float = 0.5) -> Column:
    """Why a loop of revisions ends after this one: the score is good enough, no more iterations, a worse score than before, or too little
    gain from the second iteration on; null where it goes on. The first round has no previous score."""
    gain = score - previous
    ends = [(score >= enough, "threshold"), (iteration >= most, "maximum"), (gain < 0, "regress"), ((gain < least_gain) & (iteration >= 2), "plateau")]
    return _first([(F.coalesce(c, F.lit(False)), r) for c, r in ends], F.lit(None).cast("string"))
