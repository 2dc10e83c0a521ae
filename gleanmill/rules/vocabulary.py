"""The keyword lists, patterns, labels and names the results depend on.

Everything in this module must equal what existing data was classified with, so
it is stated literally and in its natural order.  Patterns are written for a
browser-style engine; ``functions.patterns`` makes them safe for Java.
"""

from __future__ import annotations

from gleanmill.rules.pack import Rule, RulePack

# ---- collection keywords ----------------------------------------------------

KEYWORDS = (
    "DMZ", "디엠지", "비무장지대", "민통선", "민간인출입", "민간인통제선", "접경",
    "접경지역", "접경지", "군사분계선", "MDL", "유엔사", "정전협정", "군사정전위원회",
)

# ---- news -------------------------------------------------------------------

HOME_ANCHORS = RulePack((
    Rule(r"비무장지대|디엠지|군사분계선|민통선|민간인\s*통제|민간인\s*출입|판문점|공동경비구역|대성동|9[·.]\s*19\s*(군사)?합의"),
    Rule(r"\bDMZ\b", ignore_case=True),
    Rule(r"유엔군사령부|유엔사|군사정전위"),
    Rule(r"6[·.]\s*25|한국\s*전쟁|유엔군\s*참전|참전\s*용사"),
    Rule(r"남북|북한|한반도|대북|북측|남측|국군|우리\s*군|합참|합동참모본부|국방부|통일부"),
    Rule(r"파주|연천|철원|양구|인제|화천|김포|옹진|백령|연평|임진강|한강\s*하구|서해\s*5도"),
    Rule(r"강화군|강화읍|강화도(?!\s*조약)|인천\s*강화"),
))

FOREIGN_TERMS = RulePack((
    Rule(r"스페인|모로코|세우타|멜리야|지브롤터", "스페인·모로코 국경"),
    Rule(r"유럽연합|EU\s*(집행위|정상회의|국경|이사회)|솅겐|프론텍스", "유럽연합 국경", ignore_case=True),
    Rule(r"난민|망명\s*신청|이민자|밀입국|불법\s*월경|국경\s*장벽|분리\s*장벽", "난민·이민 이슈"),
    Rule(r"우크라|젤렌스키|러\s*[·\-]\s*우", "러시아-우크라이나 전선"),
))

AMBIGUOUS_TERMS = RulePack.of(
    r"러시아|모스크바|크렘린|푸틴|북[·\-\s]*러",
    r"이란|테헤란|이라크|예멘|이스라엘|가자\s*지구|팔레스타인|레바논|시리아|골란\s*고원",
    r"중국|북[·\-\s]*중|중[·\-\s]*조|압록강|두만강|백두산|만주|간도|연변|랴오닝|지린",
    r"몽골|카자흐스탄|우즈베키스탄|키르기스",
    r"대만|양안|남중국해|필리핀",
    r"멕시코|리오그란데|과테말라|온두라스|베네수엘라|콜롬비아|아이티",
    r"폴란드|벨라루스|리투아니아|라트비아|에스토니아|핀란드|헝가리|세르비아|불가리아|루마니아",
    r"파키스탄|방글라데시|카슈미르|아프가니스탄|인도[·\-]파|인도\s*(정부|군|총리|당국|북부|국경)",
    r"미얀마|캄보디아|라오스|말레이시아",
    r"아르메니아|아제르바이잔|나고르노|키프로스|압하지야|조지아\s*(공화국|정부|국경)",
    r"튀르키예|터키|그리스|쿠르드",
    r"콩고|르완다|에티오피아|에리트레아|리비아|알제리|튀니지|남수단|수단\s*(공화국|정부|내전|군|반군)|말리\s*(공화국|정부|내전|반군|북부)",
)

TRIAL_TERMS = RulePack.of(
    r"재판|선고|공판|기소|구속|영장|판결|위증|무죄|유죄|징역|송치|보석|항소심|상고심|특검|압수수색|기각|법정"
)
CORE_TERMS = RulePack.of(
    r"군사분계선|\bMDL\b|비무장지대|DMZ|판문점|민통선|유엔사|군사정전위|정전협정", ignore_case=True
)
ROUNDUP_HEADS = (
    r"^\[(연합뉴스 이 시각 헤드라인|주간 뉴스캘린더|오늘의 주요 일정|오늘의 국회일정"
    r"|총리·장차관 일정|전국 주요 신문 사설|전국 주요 신문 톱뉴스)\]"
)
CORRECTION_PREFIX = r"^\[고침\][^(]*\("

# Reason texts; %s takes the matched part.
ROUNDUP_REASON = "여러 소식을 모아놓은 목록 기사([%s]) — 목록 내 DMZ 항목 1줄로 매칭"
TRIAL_REASON = "재판·수사 기사(제목: '%s') — DMZ 언급('%s')이 본문에만 등장"
FOREIGN_REASON = "해외 국경 이슈(%s) — 한반도 앵커어 없음"
AMBIGUOUS_REASON = "규칙 판단 애매(%s) — LLM 확인 대상"
NO_PROVIDER_REASON = "GEMINI_API_KEY 미설정 — LLM 확인 생략"

# ---- bibliographic topic ----------------------------------------------------

BIB_NOISE = RulePack((
    Rule(r"minimum description length", "MDL=Minimum Description Length", ignore_case=True),
    Rule(r"\bScience\s*DMZ\b", "Science DMZ(네트워크 용어)", ignore_case=True),
    Rule(r"직접\s*경구|간접\s*경계|경계적분|직접경\b", "접경 합성어 오매칭"),
    Rule(r"장고봉|하산호|미얀마|아르메니아|아제르바이잔|키프로스|카슈미르", "해외 정전·분쟁"),
    Rule(
        r"북[·\-\s]*중[·\-\s]*(러|국경|접경)|압록강|두만강|백두산|만주|간도|연변|요동|요서|요녕|길림|동북\s*3?성|중[·\-\s]*조\s*국경",
        "한반도 밖 접경(북중/만주 등)",
    ),
    Rule(r"몽골|장성|만리장성", "한반도 밖 지역"),
    Rule(
        r"고려\s*(시대|말|초|전기|후기|시기)|조선\s*(전기|후기|시대)\s*국경|동서독|서독|동독|로마\s*제국|페르시아|합스부르크",
        "역사·해외 국경",
    ),
    Rule(r"contact\s*zone", "Contact Zone(학술 개념)", ignore_case=True),
))

BIB_CORE = RulePack((
    Rule(
        r"비무장지대|디엠지|군사분계선|민통선|민간인\s*통제|정전협정|군사정전위|유엔사|판문점|공동경비구역|JSA",
        ignore_case=True,
    ),
    Rule(r"파주|연천|철원|고성|양구|인제|화천|김포|강화(?!도조약)"),
))

# ---- scholarly or not -------------------------------------------------------

PRESS = r"신문(사)?$|일보(사)?$|방송(국)?$|미디어$|통신사?$|TV$"

NON_ACADEMIC_PUBLISHERS = RulePack.of(PRESS, r"의원실", r"사무처")
TRUSTED_SOURCES = ("riss", "kci", "ntis", "kisti")
EXEMPT_SOURCES = ("encykorea",)

NON_ACADEMIC_TITLES = RulePack((
    Rule(r"[\[<(]\s*인터뷰\s*[\]>)]", "인터뷰 기사"),
    Rule(r"[\[<(]\s*(화보|포토|르포)\s*[\]>)]", "잡지 화보·르포"),
    Rule(r"좌담회?|대담|취재기|칼럼|사설", "좌담·칼럼 등 비학술 기고"),
))
ACADEMIC_JOURNALS = RulePack((
    Rule(r"학회지$|학회$|논총$|논집$|학보$|연구$|연구지$|저널$"),
    Rule(r"journal", ignore_case=True),
))
PUBLISHER_REASON = "비학술 발행처: %s"
EXEMPT_SOURCE_REASON = "면제 소스"
BOOK_REASON = "단행본"

# ---- institutions -----------------------------------------------------------

GOV_INSTITUTIONS = (
    # economy, humanities and society
    "경제인문사회연구회", "과학기술정책연구원", "국토연구원", "대외경제정책연구원", "산업연구원",
    "에너지경제연구원", "정보통신정책연구원", "통일연구원", "한국개발연구원", "KDI", "한국교육개발원",
    "한국교육과정평가원", "한국교통연구원", "한국노동연구원", "한국농촌경제연구원", "한국법제연구원",
    "한국보건사회연구원", "한국여성정책연구원", "한국조세재정연구원", "한국직업능력연구원",
    "한국직업능력개발원", "한국청소년정책연구원", "한국해양수산개발원", "한국행정연구원",
    "한국형사·법무정책연구원", "한국형사정책연구원", "한국환경연구원", "한국환경정책·평가연구원",
    "한국환경정책평가연구원", "통계개발원",
    # defence and security
    "한국국방연구원", "국방연구원", "국가안보전략연구원", "국가안전보장문제연구소", "국방대학교",
    "국방정신전력원", "군사편찬연구소", "국방부 군사편찬연구소", "국방부군사편찬연구소",
    "육군군사연구소", "육군사관학교 화랑대연구소",
    # science and technology
    "한국과학기술연구원", "한국과학기술정보연구원", "한국건설기술연구원", "한국생명공학연구원",
    "한국생산기술연구원", "한국전자통신연구원", "한국지질자원연구원", "한국철도기술연구원",
    "한국원자력연구원", "한국항공우주연구원", "한국해양과학기술원", "한국기초과학지원연구원", "극지연구소",
    # regions
    "경기연구원", "경기개발연구원", "강원연구원", "강원발전연구원", "강원디자인진흥원", "인천연구원",
    "인천발전연구원", "서울연구원", "서울시정개발연구원", "경남연구원", "경북연구원", "대구경북연구원",
    "대전세종연구원", "부산연구원", "전북연구원", "광주전남연구원", "충남연구원", "충북연구원",
    "제주연구원", "경기북부연구원",
    # other public bodies
    "한국학중앙연구원", "대한민국학술원", "국가과학기술연구회", "동북아역사재단",
    "민주화운동기념사업회", "독립기념관", "한국독립운동사연구소", "부산광역시사편찬위원회",
    "서울역사편찬원", "국사편찬위원회", "국토지리정보원", "국립중앙도서관", "국회도서관",
    "국회입법조사처", "국회예산정책처", "한국은행", "통계청", "문화재청", "국가유산청", "산림청",
    "환경부", "통일부", "국방부", "행정안전부", "국토교통부", "해양수산부", "농촌진흥청", "기상청",
    "DMZ정책연구원", "한국임업진흥원", "한국환경공단", "한국수자원공사", "한국관광공사",
    "한국토지주택공사", "동북아평화경제협회", "국립생태원", "국립수목원", "국립산림과학원",
    "국립환경과학원", "국립문화재연구원", "국립문화재연구소", "국립생물자원관",
    "국립낙동강생물자원관", "국립통일교육원", "통일교육원", "북한자료센터",
)

PRIVATE_INSTITUTIONS = (
    # university institutes
    "통일평화연구원", "국학연구원", "규장각한국학연구원", "한국학연구원", "인천학연구원",
    "국가관리연구원", "아태지역연구센터", "인문학연구원", "대동문화연구원", "탈분단경계문화연구원",
    "통일강원연구원", "극동문제연구소", "북한대학원대학교", "DMZ연구원", "DMZ 연구원",
    # foundations and think tanks
    "한국국가전략연구원", "한국군사문제연구원", "한국전시산업융합연구원", "한국학술연구원",
    "한국법학원", "대한민국재향군인회", "평화문제연구소", "세종연구소", "아산정책연구원", "동아시아연구원",
    # names other rules would misread
    "LH토지주택연구원", "LH 토지주택연구원", "아트인컬처", "접경지역통일연구",
)

GOV_PREFIXES = RulePack.of(
    r"^국립(?!.*대학)",
    r"^國立(?!.*大學)",
    r"^(기획재정부|교육부|과학기술정보통신부|외교부|통일부|법무부|국방부|행정안전부|국가보훈부|문화체육관광부|농림축산식품부|산업통상자원부|보건복지부|환경부|고용노동부|여성가족부|국토교통부|해양수산부|중소벤처기업부)",
    r"^(국세청|관세청|조달청|통계청|검찰청|병무청|방위사업청|경찰청|소방청|국가유산청|문화재청|농촌진흥청|산림청|특허청|기상청|해양경찰청)",
)

PRIVATE_PATTERNS = RulePack((
    Rule(r"학회(지)?$"),
    Rule(r"학회 "),
    Rule(r"대학교?(\s|$)"),
    Rule(r"대학원"),
    Rule(r"大學(校|院)?(\s|$)"),
    Rule(r"University", ignore_case=True),
    Rule(r"\(주\)|주식회사|㈜"),
    Rule(r"출판(사)?$|문화사$|서원$|북스$"),
    Rule(PRESS),
    Rule(r"교회$|성당$|사찰$|불교|천주교|기독교|총무원"),
    Rule(r"협동조합$|조합$"),
    Rule(r"동산$"),
    Rule(r"협회$"),
    Rule(r"진흥회$"),
    Rule(r"연구소$"),
    Rule(r"연구회$"),
    Rule(r"연구센터$"),
    Rule(r"학술원$"),
))

GOV_PATTERNS = RulePack.of(
    r"^국립",
    r"^국방",
    r"^[가-힣]{1,8}(부|처|청)$",
    r"(특별시|광역시|특별자치시|특별자치도)$",
    r"^[가-힣]{1,6}(시청|도청|군청|구청)$",
    r"^(서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충북|충남|전북|전남|경북|경남|제주)(도)?$",
    r"^[가-힣]{1,4}(시|군|구)$",
    r"^한국[가-힣]{1,12}(진흥원|개발원)$",
    r"(공사|공단)$",
    r"연구재단$",
)

# ---- archive labels ---------------------------------------------------------

SOURCE_LABELS = {
    "kci": "KCI OpenAPI 수집",
    "riss": "RISS OpenAPI 수집",
    "ntis": "NTIS OpenAPI 수집",
    "losi": "국회도서관 LOSI OpenAPI 수집",
    "kisti": "KISTI ScienceON OpenAPI 수집",
    "encykorea": "한국민족문화대백과사전 OpenAPI 수집",
}

THEMES = (
    "접경지역",
    "DMZ 생태(DMZ 일원 등)",
    "DMZ 관광",
    "영문논문",
    "DMZ 정치군사 (정전협정,군사분계)",
    "DMZ 평화적이용(평화지대조성, 평화의길)",
    "DMZ 인문 역사",
    "정부 지자체 진행 연구용역",
    "사례조사 학술 연구",
    "DMZ 자연 산림",
    "DMZ 법제도",
    "DMZ 예술 체육(전시 공연)",
    "DMZ 문화유산 유적 유해",
    "DMZ 세계생태평화공원(그린데탕트)",
    "DMZ 메타버스(공학)",
    "DMZ 기후 환경",
    "경제협력(철도,도로)",
    "기타",
)
THEME_FALLBACK = "접경지역"

MENUS = ("PUBLICATIONS", "PAPERS", "BOOKS")
MENU_LABELS = {"PUBLICATIONS": "발간자료", "PAPERS": "논문", "BOOKS": "단행본"}
# Register prefix to (category, English category, material type).
REGISTER_KINDS = {
    "A": ("국내학술논문", "Domestic Academic Article", "article"),
    "T": ("학위논문", "Dissertation", "thesis"),
    "U": ("단행본", "Book", "book"),
}

# ---- second look at general news --------------------------------------------

TRIGGER_WORDS = ("북한산", "북한강", "남북", "거북한", "수북한", "김정은", "대북")
CONTEXT_WORDS = (
    "전투", "북한군", "파병", "무기", "군인", "전쟁", "회담", "인민", "정권", "휴전선", "정치", "대통령",
    "안보", "심리전", "위원장", "부부장", "통일", "조국통일", "대적", "전단", "탈북", "군사", "DMZ",
    "남북 단절", "참모", "전차", "미사일", "북중", "ICBM", "평양", "이탈주민", "북한식", "스포츠", "축구",
    "월드컵", "송금", "분단", "대남", "방송", "음식", "한식", "납치", "정부", "민주", "북,", "푸틴", "면담",
    "국무", "분쟁", "평화", "정당", "남한", "러시아", "위협", "한반도", "정예군", "국방", "실향민", "북향민",
    "국정", "지도자", "공산", "공화", "남북문제", "살포", "수사", "교란", "도발", "합동", "전파", "본부",
    "합참", "한미", "동맹",
)
