"""Labelled training text for the tagger: sentences written here, with generated mentions and fillers in their slots.

``{kind}`` is a labelled mention, ``<filler>`` plain generated text. Sentences are written for this module and taken
from no table; half of all snippets are composed freely (labelled fields in any order, mentions among random words),
so that a mention is known by its own form as well as by what stands around it.
"""

from __future__ import annotations

import functools
import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")

# Common Korean surnames, by frequency.
SURNAMES = "김이박최정강조윤장임한오서신권황안송류홍전고문양손배백허유남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용"
GIVEN = "민서준지우하윤도현수아은영진호경미성재연주혜나라보람슬기철상희정태훈원석규동건선화옥순자복남춘덕광창병용종승예린솔빈찬율결담온새별봄늘샘빛참한"
FIRST = ("James", "Mary", "Robert", "Linda", "Omar", "Priya", "Chen", "Sofia", "Lucas", "Helen", "Ingrid", "Pavel", "Noah", "Grace", "Victor", "Amelia", "Tomas", "Yuki", "Hassan", "Ruth", "Oscar", "Nina", "Felix", "Clara", "Hugo", "Edith")
LAST = ("Smith", "Johnson", "Garcia", "Okafor", "Novak", "Larsen", "Patel", "Hughes", "Moreau", "Tanaka", "Weber", "Rossi", "Nguyen", "Cohen", "Silva", "Murphy", "Kowalski", "Brandt", "Harper", "Winslow", "Ashdown", "Fairley", "Thornbury", "Oakes")

KO = (
    "{name} 님 우편물은 {address} 쪽으로 다시 부쳐 주세요.",
    "내일 오전에 {phone} 번을 눌러 {name} 대리를 찾으시면 됩니다.",
    "견적은 {email} 주소로만 받습니다.",
    "급한 일이면 {phone}, 아니면 {email}.",
    "보호자 {name}, 비상 연락 {phone}",
    "<role> {name}의 증언에 따르면 차는 {address} 앞에 서 있었다.",
    "<role> {name}이 서명했고 <role> {name}도 함께 있었다.",
    "지난주 {name} 기사가 {address} 현관에 상자를 두고 갔다.",
    "{name}({phone}) 앞으로 문자를 남겼으나 답이 없다.",
    "신분증에는 {id_number}, 통장에는 {name}이라고 찍혀 있었다.",
    "주민번호 {id_number} 뒷자리는 가려서 보관하세요.",
    "{id_number} 번호로 조회하니 {name} 한 사람만 나온다.",
    "예금주 {name}, 실명 확인 {id_number}",
    "저는 {name}이라고 하고요, {address}에 삽니다.",
    "저희 어머니 성함은 {name}입니다.",
    "이사 온 집은 {address}인데 아직 등기 전이다.",
    "택배는 {address} 경비실에 맡겨 주십시오.",
    "등기부에는 {address}라고만 나와 있다.",
    "수신: {name} 귀하, {address}",
    "참조 {email}, 발신 {name}",
    "답장은 {email}로 부탁드려요!",
    "팩스가 안 되면 {email}(으)로 스캔본을 올려 주세요.",
    "메일이 되돌아오면 {email} 말고 {email} 쪽으로 써 보세요.",
    "야간에는 {phone} 하나만 열려 있다.",
    "{phone}로 걸었더니 {name} 간호사가 받았다.",
    "직통은 {phone}, 대표는 {phone}입니다.",
    "회원 {name} 씨는 <w>을 취소해 달라고 했다.",
    "{name} 씨와 {name} 씨가 나란히 <w>에 왔다.",
    "{name}, {name}, {name} 세 사람이 <w>를 맡았다.",
    "{name} 교수가 쓴 <w> 소견을 붙였다.",
    "환자 {name}은 <w> 때문에 입원했다.",
    "<role> {name}에게 <w> 서류를 건넸다.",
    "<role>인 {name}가 대신 도장을 찍었다.",
    "{name} 팀장과 통화함. 번호 {phone}.",
    "{name} 님의 <w> 접수가 끝났습니다.",
    "{name} 고객이 <w> 서류를 두고 갔다.",
    "그날 {name} 선생님이 <w>을 보여 주었다.",
    "{name} 씨가 <w>을 부탁했다.",
    "제 성함은 {name}이며 <n>년째 가입 중입니다.",
    "발신인 {name} <{email}> 수신인 <w>팀",
    "받을 사람 {name}",
    "물건 받는 분 {name}",
    "도착지 {address} (<w> 앞), 수령 {name}",
    "<role>({name}, {id_number})이 <w>을 물었다.",
    "<role>({name}, {phone})과 <role>({name}, {email})",
    "명의자({name} / {id_number})",
    "{phone} 부재중, <w> 이야기는 못 함.",
    "{phone} 통화함.",
    "{phone} 연결 뒤 <w>을 물음.",
    "({id_number})",
    "{name} 및 {name} 공동으로 <w>을 청구.",
    "이름 {name}",
    "{id_number}로 등록된 {name} 회원입니다.",
    "신원 {id_number}, 메일 {email}",
    "{phone}번으로 문자 주세요.",
    "{email} 아니면 {phone}번으로 알려 주십시오.",
    "{name} 고객께서 <w> 문제로 다시 전화하셨다.",
    "증인 {name}의 진술: <w>은 <w>과 다르다.",
    "{name}·{name} 두 사람이 함께 수령한다.",
    "공동 가입자 {name}·{name}",
    "<role>는 {name}이다.",
    "<role>은 {name}, <role>는 {name}이라 한다.",
    "{name}({id_number})의 <w> 변경을 받아들였다.",
    "{name}(<role>, {phone})",
    "{phone} 받고 나서 <w> 기록을 고침.",
    "{name} 앞 <w> 통지서는 {email}로도 나갔다.",
    "<role> 성명은 {name}, 실명번호는 {id_number}.",
    "통화자 {name} / 회신 {phone} / 용건 <w>",
    "[{name}] {phone} <{email}>",
    "{name};{id_number};{phone};{email};{address}",
    "{email}, {phone}",
    "- {name} ({email})",
    "※ 바뀐 곳: {address}",
    "{address}에 사는 {name}의 번호는 {phone}이다.",
    "{name}({id_number}, {address}) 명의로 바꾼다.",
    "동의자 {name} ({id_number}) 날인",
    "{name}입니다. {email}로 <w> 보내 주세요.",
    "옛 주소 {address}, 새 주소 {address}.",
    "생년과 뒷번호는 {id_number}이고 나이는 <n>세다.",
    "외국인 등록 {id_number}, 체류 <n>개월",
)
EN = (
    "Please forward the parcel to {address} before noon.",
    "You can ring {phone} or drop a line at {email}.",
    "{name} will pick up the keys at {address}.",
    "Emergency contact: {name}, {phone}",
    "The witness, {name}, gave {phone} as a number.",
    "Mr. {name} and Mrs. {name} moved to {address} last spring.",
    "Dr. {name} signed the note on ward <n>.",
    "Ms. {name} could not be reached on {phone}.",
    "Dear {name}, thank you for writing.",
    "Regards, {name}",
    "I am {name}, and I lost my card.",
    "Copy {email} and {email} on every reply.",
    "Her SSN is {id_number} according to payroll.",
    "SSN {id_number} does not match {name}.",
    "Employee {name} ({id_number}) resigned.",
    "Tenant: {name}; unit at {address}; phone {phone}; mail {email}",
    "Deliver to {address}, attention {name}.",
    "Our house is {address}, the one with a red door.",
    "Bills still go to {address} although {name} left.",
    "Questions? {email}",
    "Fax broken, so write {email} instead.",
    "Missed call from {phone} at nine.",
    "Call back: {phone} (ask for {name})",
    "Nurse {name} told us that {name} had left.",
    "{name} asked whether <v> covers <v>.",
    "{name} said the <v> was late.",
    "According to {name}, the <v> <v> is gone.",
    "The letter from {name} got to {name} on Monday.",
    "Our agent {name} will visit you.",
    "Customer {name} disputes the <v> fee.",
    "Prepared for {name} by {name}",
    "{name}, {address}, {phone}",
    "{name} <{email}>",
    "{id_number} / {name} / {address}",
    "Passport was lost; social number {id_number} on file.",
    "Text {phone}, never {phone}.",
    "The driver, {name}, lives near {address}.",
    "I spoke with {name} and {name} about <v>.",
    "Holder {name} (no. {id_number}) wants <v>.",
    "Identity number {id_number} was checked for {name}.",
    "{name} phoned from {phone} over <v>.",
    "Line {phone} was busy, mail {email} bounced.",
    "Meet {name} tomorrow or call {phone}.",
    "Entry {id_number} belongs to another person.",
    "Registered number: {id_number}",
    "My number is {id_number}, not {id_number}.",
)
KO_NONE = (
    "이 표의 <w>은 <code> 기준을 따른다.",
    "제<n>항의 <w>는 <n>일 뒤에 효력이 생긴다.",
    "<w> 치료를 받은 사람은 <w> 자료를 내야 한다.",
    "약관 <n>쪽의 <w> 정의가 바뀌었다.",
    "<w>보험의 <w>금은 연 <n>회까지 나온다.",
    "계약자는 언제든지 <w>을 바꿀 수 있다.",
    "수익자가 없으면 상속인이 <w>금을 받는다.",
    "피보험자의 나이가 <n>세를 넘으면 <w>은 없다.",
    "설계사가 <w>을 설명하고 고객이 서명한다.",
    "담당자는 <w>을 먼저 살피고 결과를 적는다.",
    "증권 번호 <letter><long>은 잘못 적혔다.",
    "서식 <n4>-<n4> 대신 서식 <n4>-<n4>를 쓴다.",
    "고시 <n4>-<n4>에 맞추어 고친다.",
    "접수 번호는 <n12>이다.",
    "관리번호 <code>-<n4>",
    "문서 <code> 개정 20<n2>-0<d>-1<d>",
    "지급액은 <won>원이고 공제액은 <won>원이다.",
    "<w>병원과 <w>의원 두 곳에서 <w>을 받았다.",
    "<w>시에 있는 <w>센터는 <w>을 모은다.",
    "주식회사 <w>은 <w>재단과 <w> 협약을 맺었다.",
    "| <w> | <n> | <code> |",
    "## <w> 요약",
    "# 제<n>장 <w>",
    "<n>) <w>의 뜻과 <w>의 범위",
    "① <w> ② <w> ③ <w>",
    "<w>율이 <n>%를 넘으면 <w>을 줄인다.",
    "<w>은 <w>보다 <w>에 가깝다.",
    "<w>이 <w>로 옮아가면 <w>에 넣는다.",
    "회사는 <n>영업일 안에 <w>을 통지한다.",
    "<w> 검사 뒤 <w> 소견이 없으면 <w>금은 없다.",
    "부장과 과장이 함께 <w>을 심사한다.",
    "본인 또는 대리인이 <w>을 신청한다.",
    "<w>특약을 해지하면 <w>금의 <n>%를 돌려준다.",
    "<w>@<n4> 판과 <code>@<v> 판을 견준다.",
    "재발한 <w>증은 <n>개월이 지나야 한다.",
    "<w>염과 <w>통은 같은 갈래에 든다.",
    "쪽 <n> / <n>",
    "<w>사고의 <w>은 <w>원에서 확인한다.",
    "전화나 우편으로 <w>을 물을 수 있다.",
    "주소가 바뀌면 회사에 알려야 한다.",
    "이름과 주민번호는 적지 않는다.",
    "<v> 계열 <w>은 <w>에 넣지 않는다.",
    "진단 기준은 학회마다 조금씩 다르게 이루어진다.",
    "이전 계약과 이후 계약의 조건을 견주어 본다.",
    "<w> 기준(<code>)은 해마다 손본다.",
    "<w> 진단 뒤 <n>일이 지나야 효력이 난다.",
    "그러한 상태가 이어진다면 <w> 보장도 이어진다.",
    "위 사유에 한해서만 <w>을 인정한다.",
    "수술이 해외에서 이루어졌을 때도 같다.",
    "용어 풀이는 뒤쪽 부록에 실었다.",
    "지급 사유와 지급 제한을 나누어 적는다.",
    "<w> 서류(<code>)를 빠뜨리면 심사가 늦어진다.",
    "<w> 재발이 잦으면 <w>료를 더 받는다.",
    "한 가지 보장만 고를 수 있다.",
    "고지 의무를 어긴 계약은 해지될 수 있다.",
    "조정 절차는 위원회가 맡는다.",
    "조건이 맞지 않으면 심사를 다시 받는다.",
    "정상 분만과 유산은 보장에서 뺀다.",
    "장해 등급은 의사의 소견으로 정한다.",
    "신청 기한을 넘기면 권리가 사라진다.",
    "이자는 연 <n>%로 셈한다.",
    "임의로 고친 문서는 받지 않는다.",
    "지정 병원 밖의 진료는 <n>%만 나온다.",
    "차액은 다음 달 보험료에서 뺀다.",
    "주된 계약이 끝나면 특약도 끝난다.",
    "유효 기간은 <n>년이며 연장할 수 없다.",
    "배당금은 해마다 정산해서 돌려준다.",
    "노후 자금과 교육 자금을 따로 쌓는다.",
    "문서 양식은 누리집에서 내려받는다.",
    "안내문을 읽고 동의란에 표시한다.",
    "<w>술과 <w>술을 같은 날 받으면 하나로 친다.",
    "<w>은 <w>기관의 회신을 기다린다.",
    "<w>협회는 <w>값을 분기마다 알린다.",
    "<w>사고가 난 날부터 <n>일 동안 통지한다.",
    "만기 <n>개월 전에 갱신 여부를 묻는다.",
    "나이 계산은 보험 나이로 한다.",
    "청구는 인터넷, 창구, 우편 모두 된다.",
    "해당 조항은 <n>차 개정 때 없어졌다.",
    "손해율이 오르면 요율도 오른다.",
    "구체적인 금액은 별도의 표로 정한다.",
    "최종 결정은 <n>주 안에 나온다.",
    "전액 환급은 첫 달에만 된다.",
    "원본을 잃어버리면 사본으로 갈음한다.",
    "공동 명의 계약은 모두의 동의가 있어야 한다.",
    "대표 상품의 약관을 먼저 살펴본다.",
    "과장된 광고에 속지 않도록 주의한다.",
    "선생님들을 위한 단체 보험도 있다.",
    "여러 번 나누어 내면 수수료가 붙는다.",
    "성형 목적의 수술은 보장하지 않는다.",
    "연금은 <n>세부터 매달 나온다.",
    "국내 거주자만 가입할 수 있다.",
    "현재 건강 상태를 그대로 적는다.",
    "간병 보장은 <w> 등급을 받은 날 열린다.",
    "어린이 보험은 <n>세까지 든다.",
    "제<n>장 (<w>의 뜻)",
    "# <n>항 (<w>의 <w>)",
    "(<w>) 뒤에 <w>이 나온다.",
    "붙임 <n> <w> 목록",
    "[그림 생략]",
    "(용어의 풀이)",
    "용어의 쓰임은 앞 장에서 밝혔다.",
    "위 경우에 한해 <v> <w>도 인정한다.",
    "<w>에 한하는 보장이다.",
    "<w>율은 <n>%에 머문다.",
    "<w>금은 지급하지 못한다.",
    "<w>이면 지급하지 않을 때도 있다.",
    "<role>는 <w> 서류(<code>)를 <w>에 낸다.",
    "<role>은 <w> 서류를 챙긴다.",
    "<role>는 <w> 변경을 미리 알린다.",
    "<role>가 <w>으로 <w>술을 받았다.",
    "<w>염 관련 문의는 <w>에서 받는다.",
    "<role>에게 <w>증이 생기면 <w>금이 나온다.",
    "[<w> 생략함]",
    "<n>세 이전 가입자는 <w>이 다르다.",
    "<n>년 이전 <v> <w>은 따로 둔다.",
    "<w>증 진단 이후 <n>년 안에만 청구한다.",
    "<w>질환 진단을 두 번 받으면 한 번으로 친다.",
    "<w>판 <n>쪽을 고쳐서 나눈다.",
    "<v> 신경 질환, <w>병, <w>염 순서로 적는다.",
    "가입자가 <w> 서류(<code>)를 <w>에 올린다.",
    "청구인은 <w> 서류를 <n>일 안에 채운다.",
    "<w>은 진단비, <w>은 수술비에서 나간다.",
    "이전 기록과 진단 기록이 서로 다르다.",
    "<w> 계약의 <w>율 <n>%를 넘는 몫",
    "가입한 <w> 고객이 늘었다.",
    "<w>이 <w> 고정에 쓰인다.",
    "회복 뒤에 남은 증상은 후유증으로 본다.",
    "표에 없는 질병은 가까운 항목에 맞춘다.",
    "요양 병원의 입원은 연 <n>일까지이다.",
    "서면으로 알리지 않으면 계약은 그대로 간다.",
    "기재된 내용이 사실과 다르면 고쳐야 한다.",
    "<w>등급이 <n>급 이하면 <w>은 반으로 준다.",
    "통원 <n>회, 입원 <n>일, 수술 <n>번.",
    "염증이 심하면 약물 치료를 먼저 한다.",
    "신경 손상과 근육 손상은 따로 판정한다.",
    "골절과 탈구가 겹치면 무거운 쪽을 따른다.",
    "혈전이나 궤양 따위는 <w> 표에 있다.",
    "<w>낭종과 <w>종양은 <code>에 따라 나눈다.",
)
EN_NONE = (
    "Table <n> lists every <v> by code <code>.",
    "The policy pays <n> percent of <v> costs.",
    "A <v> claim needs form <code> and a report.",
    "Section <n> of the <v> terms was amended.",
    "Patients with <v> may ask for <v> care.",
    "Policy number <letter><long> has lapsed.",
    "Use notice <n4>-<n4> instead of <n4>-<n4>.",
    "<V>, like <V>, is a trade name.",
    "The <V> Institute reviews <v> data.",
    "Version <v>@<n4> comes after <code>.",
    "The insured, the payer and the agent may each object.",
    "Our office on the main street is closed.",
    "Doctors and nurses at <V> Clinic read the <v> file.",
    "Amounts over <won> are checked twice.",
    "Pages <n>-<n> cover <v> and <v>.",
    "Neither <v> nor <v> is a <v> in this sense.",
    "<V> costs rise when <v> falls below <n>.",
    "No phone or mail address is stored here.",
    "Ref <n12> was archived in 20<n2>.",
    "On <n2> May 20<n2> the <v> board met.",
)
ROLES = ("보호자", "배우자", "대리인", "상담원", "간호사", "조사원", "세입자", "변호사", "목격자", "운전자", "보증인", "통역사", "상속인", "회원", "환자", "직원", "이웃", "반장", "원장", "유족", "동료", "위임인", "가입자", "신고자", "증인", "고객", "수익자", "계약자", "신청인", "청구인", "피보험자", "설계사", "담당", "담당자", "대표자", "의사", "강사", "기사", "심사원", "참고인", "제보자", "거주자", "소유자", "임차인", "후견인", "어머니", "아버지")
TITLES = ("씨", "님", "고객", "고객님", "선생님", "과장", "팀장", "대표", "원장", "여사", "군", "양", "부장", "기사")
LABELS = {
    "email": ("메일", "이메일", "e-mail", "전자메일", "회신처", "Email", "mail to", "M"),
    "phone": ("전화", "휴대폰", "연락처", "핸드폰", "직통", "tel", "Phone", "TEL", "mobile", "T"),
    "id_number": ("주민번호", "등록번호", "실명번호", "신분번호", "SSN", "ID no", "identity", "주민등록", "id", "no.", "신분 번호"),
    "address": ("주소", "거주지", "보낼 곳", "사는 곳", "배송", "Address", "home", "소재"),
    "name": ("성함", "이름", "성명", "수신인", "예금주", "작성자", "보낸 사람", "Name", "Customer", "by", "신청", "받는 사람", "받는 분", "수령"),
}
PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "에", "에서", "로", "으로", "과", "와", "도", "만", "까지", "부터", "에게", "")
ENDINGS = ("했다.", "한다.", "합니다.", "됩니다.", "이다.", "입니다.", "없다.", "있다.", "본다.", "않는다.", "보낸다.", "드립니다.", "하였음.", "할 것.", "바람.", "요청함", "한다", "")
STREETS = ("Lane", "Road", "Street", "Drive", "Avenue", "Court", "Way", "Place", "Close", "Terrace", "St", "Ave")


@functools.cache
def syllables() -> tuple[str, ...]:
    """The 2,350 syllables of the Korean national standard set, by rule."""
    rows = (bytes([hi, lo]).decode("euc_kr") for hi in range(0xB0, 0xC9) for lo in range(0xA1, 0xFF))
    return tuple(rows)


class Writer:
    """Snippets with a tag for each character: 0 outside, 2k + 1 at the begin of a mention of kind k, 2k + 2 inside."""

    _SLOT = re.compile(r"\{(\w+)\}|<(\w+)>")

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, xs):
        return xs[int(self.r.random() * len(xs))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def digits(self, n: int) -> str:
        return f"{self.r.randrange(10**n):0{n}}"

    def hangul(self, lo: int, hi: int) -> str:
        own = syllables()
        return "".join(self.pick(own if self.chance(0.5) else GIVEN) for _ in range(self.r.randrange(lo, hi)))

    def latin(self) -> str:
        out = ""
        for _ in range(self.r.randrange(1, 4)):
            out += self.pick(("", self.pick("bcdfghjklmnprstvwz"), self.pick(("st", "th", "br", "pl", "gr", "ch", "tr", "qu")))) + self.pick("aeiou") + self.pick(("", "", self.pick("lmnrstxk"), self.pick(("nd", "ck", "ll", "ea", "io"))))
        return out if self.chance(0.95) else out.replace("e", "é").replace("u", "ü")

    def _w(self):
        """A word that is no name, though it may look like one."""
        if self.chance(0.4):
            return self.pick(SURNAMES) + self.hangul(1, 5)
        return self.hangul(2, 7)

    def _v(self):
        return self.latin()

    def _V(self):
        return self.latin().capitalize()

    def _code(self):
        return "".join(self._letter() for _ in range(self.r.randrange(1, 4))) + self.pick(("-", "-", "", "_")) + self.digits(self.r.randrange(3, 7))

    def _n(self):
        return str(self.r.randrange(1, 1000))

    def _d(self):
        return self.digits(1)

    def _n2(self):
        return self.digits(2)

    def _n4(self):
        return self.digits(4)

    def _n12(self):
        return str(self.r.randrange(1, 10)) + self.digits(self.pick((6, 7, 9, 11, 13, 14)))

    def _letter(self):
        return chr(65 + self.r.randrange(26))

    def _long(self):
        return f"{self.digits(4)}-{self.digits(self.pick((3, 4, 5)))}-{self.digits(4)}"

    def _won(self):
        return self.pick((f"{self.r.randrange(10, 9999):,}만", f"{self.r.randrange(10, 9999):,},000", self._n()))

    def _role(self):
        return self.pick(ROLES)

    def name(self, korean: bool) -> str:
        if korean:
            family = self.pick(SURNAMES[:24] if self.chance(0.6) else SURNAMES)
            given = [self.pick(GIVEN) if self.chance(0.45) else self.pick(syllables()) for _ in range(2 if self.chance(0.97) else 1)]
            return (" " if self.chance(0.12) else "").join((family, *given))
        first = self.pick((self.pick(FIRST), self._V(), f"{self._letter()}."))
        middle = f" {self._letter()}." if self.chance(0.25) and not first.endswith(".") else ""
        return f"{first}{middle} {self.pick((self.pick(LAST), self._V(), self._V() + self.pick(('son', 'man', 'ton', 'field', 'wood', 'er', 'ley'))))}"

    def phone(self, korean: bool) -> str:
        a, b = self.digits(self.pick((4, 4, 4, 3))), self.digits(4)
        s = self.pick(("-", "-", "-", ".", " ", ""))
        if korean:
            if self.chance(0.25):
                return f"+82{self.pick(('-', ' ', s, ''))}{self.pick(('10', '10', '2', '31', '70'))}{s}{a}{s}{b}"
            if self.chance(0.2):
                return f"({self.pick(('02', '031', '051', '064', '070'))}){self.pick((' ', '', '-'))}{a}-{b}"
            return s.join((self.pick(("010", "010", "010", "011", "031", "02", "070", "051", "062")), a, b))
        area, s = self.digits(3), self.pick(("-", ".", " "))
        local = f"{self.digits(3)}{s}{b}"
        return self.pick((f"+1{self.pick(('-', ' ', s))}{area}{s}{local}", f"({area}) {local}", f"({area}){local}", f"{area}{s}{local}", f"{area}{s}{local}"))

    def id_number(self, korean: bool) -> str:
        if korean:
            date = f"{self.digits(2)}{self.r.randrange(1, 13):02}{self.r.randrange(1, 32):02}"
            return date + self.pick(("-", "-", "-", "", " ", "–", " - ", "·", ".", "/")) + self.digits(7)
        s = self.pick(("-", "-", "-", " ", "–", "", ".", "·"))
        return f"{self.digits(3)}{s}{self.digits(2)}{s}{self.digits(4)}"

    def email(self, korean: bool) -> str:
        part = lambda: (self.latin() if self.chance(0.85) else self.pick(FIRST).lower()).replace("é", "e").replace("ü", "u")
        own = self.pick((part(), part() + self.pick("._-") + part(), self._letter().lower() + self.pick("._-") + part(), part() + self.digits(self.r.randrange(1, 5))))
        own += "+" + part() if self.chance(0.15) else ""
        end = self.pick(("com", "net", "org", "co.kr", "or.kr", "test", "example", "invalid", "io", "info"))
        host = self.pick((f"{part()}.{end}", f"{part()}.{part()}.{end}", f"{part()}-{part()}.{end}", f"{part()}{self.digits(2)}.{end}"))
        at, dot = "@", "."
        if self.chance(0.3):
            at = self.pick(("[at]", " (at) ", " at ", "(at)", " [at] ", "(AT)", " 골뱅이 ", "골뱅이"))
            if self.chance(0.6):
                dot = self.pick(("[dot]", "(dot)", " dot ", " (dot) ", " [dot] "))
        out = (own if self.chance(0.5) else own.replace(".", dot)) + at + host.replace(".", dot)
        return out.upper() if self.chance(0.08) else out

    def address(self, korean: bool) -> str:
        if not korean:
            town = " ".join(self._V() for _ in range(self.pick((1, 1, 2))))
            street = " ".join(self._V() for _ in range(self.pick((1, 1, 2))))
            return f"{self.r.randrange(1, 3000)} {street} {self.pick(STREETS)}, {town}" + self.pick(("", f", {self._letter()}{self._letter()} {self.digits(5)}"))
        w = self.hangul(1, 4)
        head = self.pick((w + "시", w + "시", w + "특별시", w + "광역시", w + "도 " + self.hangul(2, 3) + "시", w + "도 " + self.hangul(2, 3) + "군", w + "특별자치도 " + self.hangul(2, 3) + "시"))
        head += f" {self.hangul(1, 4)}{self.pick(('구', '구', '면', '읍'))}"
        if self.chance(0.25):
            return f"{head} {self.hangul(1, 4)}{self.pick('동리')} {self.pick(('', '', '산 '))}{self.r.randrange(1, 1200)}{self.pick(('', f'-{self.r.randrange(1, 90)}'))}"
        road = f"{head} {self.hangul(1, 5)}{self.pick(('로', '길', '대로'))} {self.r.randrange(1, 900)}"
        if self.chance(0.2):
            road = f"{head} {self.hangul(1, 4)}로 {self.r.randrange(1, 300)}번길 {self.r.randrange(1, 90)}"
        return road + self.pick(("", "", f"-{self.r.randrange(1, 40)}", f", {self.r.randrange(100, 130)}동 {self.r.randrange(100, 2500)}호", f" {self.r.randrange(2, 20)}층", f" ({self.hangul(2, 4)}동)"))

    def fill(self, template: str, korean: bool) -> tuple[str, list[int]]:
        text, tags, at = [], [], 0
        for m in self._SLOT.finditer(template):
            gap = template[at : m.start()]
            v = getattr(self, m[1])(korean) if m[1] else getattr(self, "_" + m[2])()
            k = 2 * KINDS.index(m[1]) + 1 if m[1] else 0
            text += [gap, v]
            tags += [0] * len(gap) + ([k] + [k + 1] * (len(v) - 1) if k else [0] * len(v))
            at = m.end()
        text.append(template[at:])
        return "".join(text), tags + [0] * len(template[at:])

    def _plain(self, korean: bool) -> str:
        """Words in the shape of a sentence, without any meaning."""
        if korean:
            words = [f"<w>{self.pick(PARTICLES)}" if self.chance(0.8) else self.pick(("<n>", "<code>", "<n>%", "<n>일", self.pick(ROLES))) for _ in range(self.r.randrange(2, 7))]
            return " ".join(words) + self.pick((" <w>", "", "<w>")) + self.pick(ENDINGS)
        words = [self.pick(("<v>", "<v>", "<v>", "the", "of", "for", "<n>", "and", "<V>", "<code>", "is", "was")) for _ in range(self.r.randrange(3, 10))]
        return " ".join(words) + self.pick((".", ".", "", "?"))

    def _fields(self) -> str:
        """Labelled mentions one after another."""
        kinds = [self.pick(KINDS) for _ in range(self.r.randrange(1, 5))]
        after, between = self.pick((": ", ":", " ", "=", " : ", " - ", "(", "]")), self.pick((", ", " / ", "; ", "\n", " ", " | ", " · "))
        close = {"(": ")", "]": ""}.get(after, "")
        opened = "[" if after == "]" else ""
        return between.join(f"{opened}{self.pick(LABELS[k])}{after}{{{k}}}{close}" for k in kinds)

    def _among(self, korean: bool) -> str:
        """A mention among random words; a Korean name has a role before or a title or particle after it."""
        kind = self.pick((*KINDS, "id_number", "phone"))
        mid = f"{{{kind}}}"
        if kind == "name":
            if korean:
                role = self.pick((self.pick(ROLES) + " ", self.pick(ROLES) + " ", self.pick(ROLES) + "인 ", self.pick(LABELS["name"]) + " ", self.pick(ROLES) + "("))
                mid = self.pick((f"{role}{mid}{self.pick(('은', '는', '이', '가', '의', '에게', '께', ',', '(', '과', '와', '를', '을', ' ', '도', '이고', '입니다'))}", f"{mid} {self.pick(TITLES)}{self.pick(PARTICLES)}", f"{role}{mid} {self.pick(TITLES)}"))
            else:
                mid = self.pick((f"{self.pick(('Mr. ', 'Ms. ', 'Dr. ', 'Mrs. ', 'Mr ', 'to ', 'by ', 'from ', 'with ', 'agent ', 'client ', 'Thank ', 'Meet ', 'Tell ', 'See ', 'Prof. '))}{mid}", f"{mid} {self.pick(('said', 'wrote', 'called', 'asked', 'has', 'met', 'paid', 'will', 'and', 'lives', 'was'))}"))
        elif not korean and self.chance(0.4):
            mid = self.pick(LABELS[kind]) + self.pick((" ", ": ", " (", " is ", ". ")) + mid
        elif korean and self.chance(0.5):
            mid += self.pick(("로", "으로", "에", "에서", "입니다", "번", "이며", "인데", "의", "은", "을", ")", "앞", "이고"))
            if self.chance(0.5):
                mid = self.pick(LABELS[kind]) + self.pick((" ", "는 ", "은 ", "(", ": ", "가 ")) + mid
        a, b = self._plain(korean), self._plain(korean)
        return f"{a.rstrip('.')} {mid}{self.pick((' ', ' ', ', ', '. '))}{b}"

    def sentence(self) -> tuple[str, list[int]]:
        korean = self.chance(0.55)
        u = self.r.random()
        if u < 0.34:
            t = self.pick(KO if korean else EN)
        elif u < 0.56:
            t = self._among(korean)
        elif u < 0.64:
            t = self._fields()
        elif u < 0.86:
            t = self.pick(KO_NONE if korean else EN_NONE)
        else:
            t = self._plain(korean)
        out, tags = self.fill(t, korean)
        if not korean and self.chance(0.04):
            out = out.upper()
        if self.chance(0.03):  # stray blanks of scanned pages
            noisy: list[tuple[str, int]] = []
            for c, k in zip(out, tags, strict=True):
                noisy.append((c, k))
                if self.chance(0.05):
                    noisy.append((" ", k + 1 if k % 2 else k))
            out, tags = "".join(c for c, _ in noisy), [k for _, k in noisy]
        return out, tags

    def passage(self, length: int) -> tuple[str, list[int]]:
        text, tags = "", []
        while len(text) < length:
            s, t = self.sentence()
            gap = self.pick((" ", " ", "\n", "\n\n"))
            text, tags = text + s + gap, tags + t + [0] * len(gap)
        cut = self.r.randrange(len(text) - length + 1)
        return text[cut : cut + length], tags[cut : cut + length]


@functools.cache
def own_characters() -> tuple[str, ...]:
    """The characters that the sentences of this module are written in."""
    parts = (*KO, *KO_NONE, *ROLES, *TITLES, *PARTICLES, *ENDINGS, *(x for xs in LABELS.values() for x in xs), SURNAMES, GIVEN, "시도군구면읍동리로길대번호층산특별광역자치골뱅이·–…①②③“”\n")
    return tuple(sorted({c for s in parts for c in s} | {chr(c) for c in range(32, 127)}))
