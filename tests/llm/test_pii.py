import numpy as np
import pytest

from textloom.llm import pii
from textloom.llm.tagger import Tagger


def test_gradients_against_differences():
    m = Tagger(12, 5, hidden=4, seed=1)
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, 12, (6, 3)), np.zeros((6, 3), int)
    tags[1], tags[2] = 1, 2
    _, g = m.gradients(ids, tags)
    for k, x in g.items():
        i = np.unravel_index(np.abs(x).argmax(), x.shape)
        m.p[k][i] += 1e-2
        up = m.gradients(ids, tags)[0]
        m.p[k][i] -= 2e-2
        down = m.gradients(ids, tags)[0]
        m.p[k][i] += 1e-2
        assert abs((up - down) / 2e-2 - x[i]) < 2e-3


@pytest.fixture(scope="module")
def model():
    return pii.trained()


# Carriers that the generator does not have.
HELD_KO = (
    "오늘 아침 {name} 님이 창구에서 <w> 신청서를 새로 썼습니다.",
    "문의가 있으면 {phone} 아니면 {email} 쪽이 빠릅니다.",
    "신분 확인을 위해 {id_number} 를 불러 달라고 했다.",
    "임대인 {name}의 집은 {address}로 되어 있다.",
    "서류 봉투에는 {address}, {name} 앞이라고 써 있었다.",
    "<w> 보험금은 {name} 고객 계좌로 넣었다.",
    "휴대전화가 꺼져 있어 {phone}에 음성을 남김.",
    "회신 메일: {email} (담당 {name})",
    "작년에 {address}에서 이사했다고 한다.",
    "주민등록번호는 {id_number}로 확인되었다.",
    "계약자 {name}, 전화 {phone}, 주소 {address}.",
    "보험 설계사 {name} 씨가 <w> 상품을 권했다.",
    "청구인은 {name}이고 대리인은 {name}입니다.",
    "새로 받은 메일 주소가 {email}이라고 합니다.",
    "팩스 대신 {email} 계정을 쓰세요.",
    "응급실에서 {name} 환자를 <w>과로 옮겼다.",
    "{phone} 번호는 이제 쓰지 않아요.",
    "우리 집 {address} 근처에서 사고가 났다.",
    "주소 변경: {address}",
    "{name} 부장과 {name} 대리가 회의에 왔다.",
    "본인 {name} (번호 {id_number})은 위 내용에 동의한다.",
    "상속인 {name}, {name} 앞으로 나누어 지급.",
)
HELD_EN = (
    "We mailed the cheque to {address} on Tuesday.",
    "The adjuster, {name}, inspected the car.",
    "If you need help, dial {phone}.",
    "Write to {email} for a copy.",
    "Mrs. {name} owns the flat at {address}.",
    "Number on file: {id_number}.",
    "Taxpayer {id_number} has not filed.",
    "{name} told the desk that the <v> was wrong.",
    "Reach {name} by phone at {phone}.",
    "Ask Dr. {name} about <v>.",
    "Our records show {address} as the residence.",
    "Reply address {email}, hotline {phone}.",
    "Beneficiary: {name}",
    "The caller left {phone} and hung up.",
    "Mr. {name} was born abroad; his number is {id_number}.",
    "Visit us at {address} any day.",
)


def held_out(n=600, seed=4321):
    from textloom.llm import carriers as C

    w = C.Writer(seed)
    texts, gold = [], set()
    for i in range(n):
        korean = i % 2 == 0
        s, t = w.fill(w.pick(HELD_KO if korean else HELD_EN), korean)
        none, _ = w.fill(w.pick(C.KO_NONE if korean else C.EN_NONE), korean)
        texts.append(none + " " + s)
        gold |= {(i, pii.KINDS[(k - 1) // 2], len(none) + 1 + j) for j, k in enumerate(t) if k % 2}
    return texts, gold


def scores(texts, gold, model, **how):
    got = {(i, k, a) for i, spans in enumerate(pii.spans_of(texts, model, **how)) for k, a, _ in spans}
    kinds = {k: (len([x for x in gold & got if x[1] == k]), len([x for x in gold if x[1] == k]), len([x for x in got if x[1] == k])) for k in pii.KINDS}
    return len(gold & got) / len(gold), len(gold & got) / len(got), {k: (round(b / t, 3), round(b / g, 3)) for k, (b, t, g) in kinds.items()}


def test_accuracy_on_carriers_never_trained_on(model):
    texts, gold = held_out()
    recall, precision, kinds = scores(texts, gold, model)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, kinds)
    assert min(r for r, _ in kinds.values()) >= 0.8, kinds


def test_leaving_out_uncovered_characters_changes_nothing():
    r = np.random.default_rng(5)
    for trial in range(60):
        m = Tagger(3, 11, 4, seed=trial)
        m.p["trans"] = r.normal(0, 1, (11, 11)).astype("f4")
        ends = np.concatenate([[0], np.cumsum(r.integers(1, 40, 5))])
        e = r.normal(0, 1.5, (ends[-1], 11)).astype("f4")
        e[:, 0] += r.uniform(0, 5)
        inside = pii.covered(e, ends[:-1], m.transitions())
        for a, b in zip(ends, ends[1:], strict=False):
            want, got = m.decode([e[a:b]])[0], np.zeros(b - a, int)
            at = np.flatnonzero(inside[a:b])
            for p in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                got[p[0] : p[-1] + 1] = m.decode([e[a + p[0] : a + p[-1] + 1]])[0]
            assert (got == want).all()


def test_mentions_and_redaction(spark, model):
    text = "보호자 김민서 님 휴대폰 ０１０-0237-4908, 이메일 bor.quillm@haon.test 로 알려 주세요."
    far = "이 표의 항목은 PN-33117 기준에 맞춘다.\n" * 300 + text
    rows = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (None, text, "x"), (4, "증권 번호 L5700-0489-7846, 서식 6166-1888 참고.", "x"), (5, far, "x"), (6, text, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {(r.doc_id, r.kind, r.char_start) for r in pii.mentions(df).collect()}
    one = {("name", 4), ("phone", 14), ("email", 33)}
    assert got == {(d, k, a + (len(far) - len(text) if d == 5 else 0)) for d in (1, 5, 6) for k, a in one}
    red = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert red[1] == "보호자 [NAME] 님 휴대폰 [PHONE], 이메일 [EMAIL] 로 알려 주세요."
    assert red[3] == "" and red[4] == rows[4][1]
    assert pii.mentions(df.limit(0)).count() == 0
