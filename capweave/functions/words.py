"""Word lists and thresholds of the register domain."""

# Labels of aggregate rows, compared without spaces.
AGGREGATE_LABELS = (
    "소계", "합계", "총계", "계", "합", "총", "소", "total", "합 계", "소 계",
    "주주총수", "총주식수", "배정주식수", "발행주식총수", "총 주식수", "배정 주식수",
)
# Share types that count as known.
SHARE_TYPES = ("보통주", "우선주", "RCPS", "전환우선주", "상환전환우선주", "종류주식", "의결권없는주식")
COMMON, PREFERRED = "보통주", "우선주"
# Words of addresses, for the row test and for the validity test.
ADDRESS_WORDS = ("시", "구", "동", "로", "길", "번지", "아파트", "APT", "읍", "면", "리")
# Words of addresses inside names read by OCR.
NAME_ADDRESS_WORDS = ("시", "구", "동", "로", "길", "번지", "아파트", "호(", "동,")
# Provinces and cities; endings of administrative units, and of places.
PLACES = (
    "서울", "경기도", "경기", "부산", "대구", "인천", "광주", "대전",
    "울산", "강원도", "강원", "충청남도", "충남", "충청북도", "충북",
    "경상남도", "경남", "경상북도", "경북", "전라남도", "전남",
    "전라북도", "전북", "제주도", "제주", "세종",
)
UNIT_ENDINGS, PLACE_ENDINGS = "시구읍면리동", "시구읍면리동로길층호"
# Column headings.
HEADINGS = (
    "주주명", "주식종류", "주식수", "성명", "이름", "종류", "수량",
    "지분율", "비율", "번호", "순번", "성 명", "주주 명", "no", "no.",
)
# Words that no inserted row may hold.
INSERT_REJECTS = (
    "주주총수", "총주식수", "배정주식수", "법인설립등기일",
    "서기", "(인)", "지식산업센터", "등기", "설립일",
    "발행주식", "자본금", "액면가", "납입", "잔고",
    "대표이사", "주권번호", "미발행",
    "주주명부", "법인세법", "시행규칙", "별지", "관리번호",
    "변동상황", "상장여부", "무액면주식", "주식등변동상황명세서",
    "사업자등록번호", "주권상장여부", "출자좌수", "실명전환",
)
# Words of signature and registry rows.
SIGNATURE_WORDS = ("법인설립등기일", "서기", "지식산업센터", "등기부", "설립일")
# Words of tax forms (one holds another, so one phrase can count twice).
FORM_WORDS = (
    "법인세법", "시행규칙", "별지", "변동상황명세서", "관리번호",
    "주권상장여부", "무액면주식", "사업자등록번호", "변동상황",
    "출자좌수", "실명전환",
)
# Words that no model row may hold.
MODEL_REJECTS = (
    "법인세법", "시행규칙", "별지", "관리번호", "변동상황명세서",
    "주권상장여부", "무액면주식", "출자좌수", "사업자등록번호",
)
# Organisations named in a trailing parenthesis; the scoring adds one.
ORGANISATIONS = (
    "업무집행조합원", "주식회사", "유한회사", "유한책임회사",
    "재단법인", "사단법인", "창조경제혁신센터", "혁신센터",
)
SCORING_ORGANISATIONS = (*ORGANISATIONS, "자기주식")
# Compounds that scoring writes without inner spaces.
COMPOUNDS = ("투자조합", "개인투자조합", "산학협력단", "투자펀드", "창업초기", "벤처투자", "기술지주")
# Words of entities whose short names look cut off.
ENTITY_WORDS = ("펀드", "조합", "주식회사", "재단법인", "투자", "산학")
# Labels of totals in text.
TOTAL_LABELS = ("합계", "총계", "소계")
CHIEF = "대표이사"
#: Roman numeral glyphs, from U+2160 (capital) and U+2170 (small).
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")

# Thresholds.
SUM_DEFICIT, SUM_DEFICIT_TEXT = 0.95, 0.85
AGGREGATE_TOLERANCE = 0.02
FACE_LOW, FACE_HIGH, FACE_COVERAGE, FACE_SPREAD, FACE_AGREEMENT = 100, 10_000, 0.7, 0.15, 0.05
DUPLICATE_PAGE = 0.5
MEDIAN_FACTOR, INSERT_LIMIT, COUNT_LIMIT = 100, 100_000_000, 10_000_000_000
