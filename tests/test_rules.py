import pytest
from pyspark.sql import functions as F

from gleanmill.rules import cascades as C
from gleanmill.rules import vocabulary as V
from tests.conftest import evaluate

PUBLISHERS = [
    ("통일연구원", "GOV", "dict"),
    ("한국환경연구원", "GOV", "dict"),
    ("경기연구원", "GOV", "dict"),
    ("국립생태원", "GOV", "dict"),
    ("(재)강원연구원", "GOV", "dict"),
    ("국립수목원", "GOV", "dict"),
    ("강원도청", "GOV", "pattern"),
    ("파주시", "GOV", "pattern"),
    ("외교부", "GOV", "pattern"),
    ("병무청", "GOV", "pattern"),
    ("한국수목보호진흥원", "GOV", "pattern"),
    ("대한건축학회", "PRIVATE", "pattern"),
    ("한국조경학회", "PRIVATE", "pattern"),
    ("서울대학교 환경대학원", "PRIVATE", "pattern"),
    ("대진대학교 DMZ연구원", "PRIVATE", "dict"),
    ("통일평화연구원", "PRIVATE", "dict"),
    ("경인문화사", "PRIVATE", "pattern"),
    ("대한불교조계종 총무원", "PRIVATE", "pattern"),
    ("한국DMZ평화생명동산", "PRIVATE", "pattern"),
    ("공공정책연구소", "PRIVATE", "pattern"),
    ("법학연구소", "PRIVATE", "pattern"),
    ("극지연구소", "GOV", "dict"),
    ("", "PRIVATE", "default"),
    ("국방부군사편찬연구소", "GOV", "dict"),
    ("국립한밭대학교", "PRIVATE", "pattern"),
]


def test_institutions(spark):
    got = evaluate(spark, [p for p, _, _ in PUBLISHERS], C.institution_rule("v"))
    assert [(r["verdict"], r["by"]) for r in got] == [(v, b) for _, v, b in PUBLISHERS]
    assert evaluate(spark, ["이상한이름기관"], C.institution_rule("v")) == [None]


def test_bib_topic(spark):
    noise = [
        "Science DMZ 네트워크 아키텍처 성능 분석",
        "Minimum Description Length 기반 모델 선택",
        "북·중 접경지역 교역 연구",
        "압록강 유역 생태 조사",
        "간도 협약의 국제법적 검토",
        "고려시대 국경 방어체계 연구",
        "동서독 접경지역 통합 사례",
        "미얀마 정전협정과 소수민족",
        "Contact Zone으로서의 문학 공간",
    ]
    core = [
        "DMZ 비무장지대의 생태 가치",
        "군사분계선 일대 산림 조사",
        "파주 접경지역 관광 활성화 방안",
        "정전협정 체제와 유엔사의 역할",
    ]
    got = evaluate(spark, noise + core, C.bib_rule("v"))
    assert [r["by"] for r in got] == ["rule-drop"] * 9 + ["rule-keep"] * 4
    assert got[0]["reason"] == "Science DMZ(네트워크 용어)"
    assert evaluate(spark, ["접경지역의 미래"], C.bib_rule("v")) == [None]


ACADEMIC = [
    (dict(source="riss", publisher="경향신문사"), False, "rule-publisher"),
    (dict(publisher="한기호 의원실"), False, "rule-publisher"),
    (dict(publisher="국회사무처 국회민원지원센터"), False, "rule-publisher"),
    (dict(source="encykorea", publisher="한국학중앙연구원"), True, "rule-exempt"),
    (dict(material_type="book"), True, "rule-exempt"),
    (dict(source="kci"), True, "source-flag"),
    (dict(source="ntis", material_type="report"), True, "source-flag"),
    (dict(title="접경지 규제 사슬 끊고 :김 의원 [인터뷰]"), False, "rule-title"),
    (dict(title="DMZ 평화 좌담회"), False, "rule-title"),
    (dict(journal="한국환경생태학회지"), True, "rule-journal"),
    (dict(journal="Korean Journal of Ecology"), True, "rule-journal"),
    (dict(title="세계의 분열을 거부한다", journal="주간경향"), None, None),
]


def test_academic(spark):
    base = dict(source="losi", title="제목", publisher="한국조경학회", journal=None, material_type="article")
    rows = [(i, *{**base, **over}.values()) for i, (over, _, _) in enumerate(ACADEMIC)]
    frame = spark.createDataFrame(rows, "i int, source string, title string, publisher string, journal string, material_type string")
    got = frame.select("i", C.academic_rule("source", "title", "publisher", "journal", "material_type").alias("r")).orderBy("i").collect()
    assert [(r.r and r.r.academic, r.r and r.r.by) for r in got] == [(a, b) for _, a, b in ACADEMIC]


NEWS = [
    ("남북 접경지역 파주서 대북전단 살포", "군 당국은 군사분계선 인근 동향을 주시하고 있다.", "anchor-keep"),
    ("스페인-모로코 접경서 난민 수백명 월경 시도", "유럽연합은 세우타 국경 통제를 강화하기로 했다.", "rule-drop"),
    ("그리스, 국경 통제를 강화", "난민 유입이 늘자 대책을 내놨다.", "rule-drop"),
    ("6·25 참전국 콜롬비아, DMZ 평화의 길 방문", "", "anchor-keep"),
    ("튀르키예 참전용사 유족, 판문점 견학", "", "anchor-keep"),
    ("콜롬비아 접경 지역서 반군 충돌", "현지 매체 보도.", "ambiguous-keep"),
    ("러-우크라 접경지대 무인기 공습", "", "rule-drop"),
    ("젤렌스키, 접경 방어선 시찰", "", "rule-drop"),
    ("러시아, 접경 훈련에 신형 무기 투입", "현지 매체 보도.", "ambiguous-keep"),
    ("수단 내전 접경지 교전", "", "ambiguous-keep"),
    ("인도-파키스탄 접경 총격", "", "ambiguous-keep"),
    ("접경지역 감시 수단 확대", "", "default-keep"),
    ("접경지 주민 인도적 지원 논의", "", "default-keep"),
    ("통일부, 접경지역 정책 유럽 사례 참고", "독일 사례를 검토한다.", "anchor-keep"),
    ("스페인 접경 난민 급증…우크라이나 피란민도 유입", "유럽연합이 대책을 논의한다.", "rule-drop"),
    ("dmz를 걷다", "", "anchor-keep"),
    ("접경지역 지원 조례 개정안 의결", "주민 편의시설 예산.", "default-keep"),
    ("'재판 위증' 항소심 오늘 선고", "무인기를 군사분계선(MDL) 너머로 보낸 혐의.", "trial-drop"),
    ("대통령, 무인기 침투에 유감", "군사분계선을 넘은 사건.<br>검찰이 기소했다.", "anchor-keep"),
    ("DMZ 평화의 길 조성사업 특혜 의혹…업체 대표 기소", "검찰은 기소했다.", "anchor-keep"),
    ("[오늘의 주요 일정](21일·수)", "군사분계선 소식.", "roundup-drop"),
    ("[고침] 기타([주간 뉴스캘린더](23일∼3월1일)-2)", "DMZ 일정.", "roundup-drop"),
    ("[영상] 잇따르는 MDL 침범…무슨 일?", "군사분계선 일대.", "anchor-keep"),
]


def _news(spark, rows, rules=C.NewsRules()):
    frame = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, title string, content string")
    return [r.r for r in frame.select("i", C.news_rule("title", "content", rules).alias("r")).orderBy("i").collect()]


def test_news_rules(spark):
    got = _news(spark, NEWS)
    assert [r.by for r in got] == [by for _, _, by in NEWS]
    assert "스페인·모로코 국경" in got[1].matched
    assert got[17].matched == ["재판", "군사분계선"]
    assert got[20].matched == ["오늘의 주요 일정"]


def test_news_switches(spark):
    foreign, trial, roundup = NEWS[1], NEWS[17], NEWS[20]
    assert _news(spark, [foreign], C.NewsRules(filter_on=False))[0].by == "filter-off"
    assert _news(spark, [trial], C.NewsRules(trial_on=False))[0].by == "anchor-keep"
    assert _news(spark, [roundup], C.NewsRules(roundup_on=False))[0].by == "anchor-keep"
    assert _news(spark, [trial], C.NewsRules(filter_on=False))[0].by == "trial-drop"


def test_menu_and_kinds(spark):
    frame = spark.createDataFrame(
        [(0, "book", "GOV"), (1, "book", "PRIVATE"), (2, "report", "PRIVATE")], "i int, kind string, verdict string"
    )
    got = [r[0] for r in frame.orderBy("i").select(C.menu_of("kind", "verdict")).collect()]
    assert got == ["PUBLICATIONS", "BOOKS", "PAPERS"]
    assert evaluate(spark, ["RISS:A1", "RISS:t2", "RISS:U3", "x"], C.material_by_register("v")) == [
        "article", "thesis", "book", "article",
    ]


def test_two_hit(spark):
    got = evaluate(spark, ["북한산 등산", "김정은 정권 군사 도발", "봄 소식", "남북 회담"], C.two_hit("v"))
    assert [(r.passed, len(r.matched)) for r in got] == [(False, 0), (True, 3), (True, 0), (False, 1)]


def test_page_gate_and_links(spark):
    def gate(media, keyword, words=None):
        return C.page_topic_ok(F.lit("제목"), F.col("v"), F.lit(media), F.lit(keyword), words)

    assert evaluate(spark, ["about the dmz", "other"], gate(True, False)) == [True, False]
    assert evaluate(spark, ["other"], gate(False, False)) == [True]
    assert evaluate(spark, ["other"], gate(True, True)) == [True]
    assert evaluate(spark, ["a (x) b", "ax"], gate(True, False, ["(X)", "y+"])) == [True, False]
    allowed = C.link_allowed("v", F.lit("h.example"), "h.example", ["/a/1/", "/b/2/"])
    assert evaluate(spark, ["http://h/a/1/x", "/c", "/a/1/sections-offices/"], allowed) == [True, False, False]


def test_rules_as_rows(spark):
    pack = V.FOREIGN_TERMS
    frame = spark.createDataFrame([(1, "난민과 스페인"), (2, "없음")], "id int, text string")
    got = {tuple(r) for r in pack.matching_rules(frame, "text").select("id", "rule").collect()}
    assert got == {(1, "스페인·모로코 국경"), (1, "난민·이민 이슈")}


@pytest.mark.parametrize("pack", [V.HOME_ANCHORS, V.BIB_NOISE, V.PRIVATE_PATTERNS])
def test_test_stays_in_codegen(spark, pack):
    frame = spark.createDataFrame([("x",)], "v string").where(pack.test(F.col("v")))
    plan = frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert "*(1) Filter" in plan
