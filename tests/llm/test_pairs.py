import json

import numpy as np
import pytest

from millrace.llm import pairs

NONE = pairs.Endings(np.zeros(pairs.BUCKETS, dtype=np.int64), np.zeros(pairs.BUCKETS, dtype=np.int64))
Q = "Explain why the tall tower near the river is closed in winter."
ZH = "请解释高塔为什么在冬天关闭，并说明河边的灯塔起什么作用。"


def fitted():
    prose = ["The tower is closed because of the ice on the stairs. Visitors come back in spring when the stairs are dry."] * 30
    return pairs.Endings(*pairs.ending_counts(prose))


@pytest.mark.parametrize(
    "question,answer,want",
    [
        (Q, None, "empty"),
        (Q, " \n", "empty"),
        (Q, "???", "empty"),
        (Q, "N/A", "empty"),
        (ZH, "（无）", "empty"),
        (Q, "<empty>", "empty"),
        (Q, Q, "copy"),
        (Q, Q.upper() + "\n" + Q, "copy"),
        (Q, "You asked: " + Q, "copy"),
        (ZH, "您问：" + ZH, "copy"),
        (Q, Q + " Because of ice.", None),
        (Q, "I'm sorry, but I can't help with that.", "refusal"),
        (Q, "Unfortunately, I'd rather not answer this one, as I lack the needed access!", "refusal"),
        (ZH, "很遗憾，我不能提供这方面的帮助，因为它可能不安全。", "refusal"),
        (Q, "Leider gilt: diese Bitte muss ich ablehnen.", "refusal"),
        (Q, "Lo siento, no me es posible responder a esto.", "refusal"),
        (Q, "I can't think of a better tower than the tall one near the river.", None),
        (Q, "Dear Ann, I am sorry that the tower was closed and cannot undo it. The ice was thick. Yours, Bob", None),
        (ZH, "对不起，让您久等了——这是信的开头。高塔冬天结冰，所以关闭。", None),
        (Q, "I cannot say it better than the sign: the stairs freeze in winter, so the tower is closed until spring.", None),
        (Q, "The tower is closed because the stairs freeze and", "truncated"),
        (Q, "The stairs freeze (which happens every", "truncated"),
        (Q, "Here is code.\n```python\nx = 1", "truncated"),
        (Q, '{"tower": "closed", "n": [1, 2', "truncated"),
        (Q, "There are 3 steps.\n1. Look at the ice.\n2. Close the door.", "truncated"),
        (ZH, "它的原因有三点：第一，结冰；第二，", "truncated"),
        (Q, "There are 2 steps.\n1. Look at the ice.\n2. Close the door.", None),
        (Q, '{"tower": "closed", "n": 12}', None),
        (Q, "42", None),
        (Q, "winter", None),
        (Q, "- ice on stairs\n- wind at night", None),
        (Q, 'The guard says: "no tower opens in winter."', None),
        (Q, "高塔在冬天结冰，所以关闭，春天再开放。", "wrong_language"),
        (Q, "Cuando el río parece frío, la torre queda cerrada y no hay visitas por la nieve.", "wrong_language"),
        (ZH, "The tower is closed in winter because the stairs are covered with ice.", "wrong_language"),
        ("Translate into Chinese: The tower is closed in winter.", "高塔在冬天关闭，春天再开放。", None),
        ("把下面的话译成英文：高塔在冬天关闭。", "The tower is closed in the winter.", None),
        (None, "The tower is closed in winter.", None),
    ],
)
def test_first_defect(question, answer, want):
    assert pairs.defect(question, answer, fitted()) == want


def test_stored_pairs_are_split():
    for text in ("Q: a b\nA: c d", "Question: a b\nAnswer: c d", "用户：a b\n助手：c d", "问：a b\n答：c d", "<user>a b</user>\n<assistant>c d</assistant>", "### Instruction:\na b\n\n### Response:\nc d", "Human: a b\n\nAssistant: c d", "[INST] a b [/INST] c d"):
        q, a = pairs.split_pair(text)
        assert (q.strip(), a.strip()) == ("a b", "c d"), text
    assert pairs.split_pair("Q: only a question") == ("only a question", None) and pairs.split_pair(None) == (None, None)


def test_long_answers_and_odd_payloads():
    assert pairs.defect(Q, "word " * 50_000 + "end.", NONE) is None
    assert list(pairs.message_pairs("no json")) == [] and list(pairs.message_pairs(None)) == [] and list(pairs.message_pairs('{"conversations": [1, null]}')) == []
    payload = json.dumps({"conversations": [{"role": "user", "content": "q"}, {"role": "assistant", "tool_calls": "[1]"}, {"role": "assistant", "content": 5}]})
    assert list(pairs.message_pairs(payload)) == [(1, "q", None)]


def test_tables(spark):
    conv = lambda *m: json.dumps({"conversations": [{"role": r, "content": c} for r, c in m]})
    schema = "candidate_id string, payload_json string, text string, defect string"
    rows = [("a", conv(("user", Q), ("assistant", None), ("user", Q), ("assistant", "Because of ice on the stairs.")), "x", "y"), ("b", "broken", None, None), ("c", None, None, None), (None, conv(("assistant", "")), None, None)]
    candidates = spark.createDataFrame(rows + rows[:1], schema)
    raw = spark.createDataFrame([(7, "Q: hm\nA: ...", 1), (7, "Q: hm\nA: ...", 2), (8, None, 3), (9, "", 4)], "record_id long, text string, record_key int")
    got = sorted(tuple(r) for r in pairs.defective_pairs(candidates, raw).collect())
    assert got == [("candidates", "a", 0, "empty"), ("raw_pairs", "7", 0, "empty"), ("raw_pairs", "8", 0, "empty"), ("raw_pairs", "9", 0, "empty")]
    assert pairs.defective_pairs(candidates.limit(0), raw.limit(0)).count() == 0


REFUSALS = [
    "I'm afraid that's beyond what I can do for you.", "Sorry, this is something I must refuse.", "I won't be answering this question.", "That request falls outside my remit, so I have to say no.", "I regret that I cannot fulfill this request.", "I do not feel comfortable answering that.", "No, I will not write this.", "I'd prefer not to say.",
    "Je suis désolé, mais je ne peux pas répondre à cette question.", "Malheureusement, je ne suis pas en mesure de vous aider.", "Je préfère ne pas répondre.", "Désolée, il m'est impossible de fournir cette information.",
    "Desculpe, não posso ajudar com isso.", "Infelizmente, não me é possível responder a esta pergunta.", "Lamento, mas devo recusar este pedido.", "Mi dispiace, non posso rispondere a questa domanda.", "Purtroppo non sono in grado di aiutarti.", "Devo rifiutare questa richiesta.",
    "Helaas kan ik deze vraag niet beantwoorden.", "К сожалению, я не могу помочь с этим.", "申し訳ありませんが、そのご質問にはお答えできません。", "残念ながら、お手伝いすることはできません。", "죄송하지만 이 질문에는 답변할 수 없습니다.",
    "Leider kann ich diese Frage nicht beantworten.", "Dazu möchte ich mich nicht äußern.", "Lo siento, pero no puedo ayudarte con eso.", "很遗憾，我不能满足您的要求。",
]
ANSWERS = [
    "Je ne peux pas imaginer un hiver sans neige, et la tour ferme donc en novembre.", "La torre no puede abrir porque el hielo cubre la escalera.", "Non posso dire meglio: la torre chiude per il ghiaccio sulle scale.", "The keeper will not open it because ice covers the stairs.", "塔は冬に凍るため、開けることができません。", "Башня не может работать зимой из-за льда на лестнице.",
    "Der Turm kann im Winter nicht öffnen, weil Eis auf der Treppe liegt.", "They had to decline the tour, since the stairs freeze over every December and melt in March.", "No comment was given by the mayor, but ice is why the tower closes.",
]
FOREIGN = [
    "Tornet är stängt på vintern eftersom trapporna är täckta av is och det inte är säkert att gå där.", "Wieża jest zamknięta w zimie, ponieważ na schodach jest lód i nie jest tam bezpiecznie.", "Tòa tháp đóng cửa vào mùa đông vì cầu thang bị đóng băng và không an toàn cho người đi.", "Kule kışın kapalıdır çünkü merdivenler buzla kaplıdır ve bu çok tehlikeli.",
    "La tour est fermée en hiver parce que les marches sont couvertes de glace.", "A torre fica fechada no inverno porque as escadas estão cobertas de gelo.", "Башня закрыта зимой из-за льда на лестнице.", "塔は冬に階段が凍るため閉まっています。", "Ο πύργος είναι κλειστός τον χειμώνα.",
]


def test_refusals_and_languages_beyond_the_tables():
    assert [t for t in REFUSALS if pairs.defect(Q, t, NONE) != "refusal"] == []
    assert [t for t in ANSWERS if pairs.is_refusal(t, Q)] == []
    assert [t for t in FOREIGN if pairs.defect(Q, t, NONE) != "wrong_language"] == []
    assert not pairs.is_foreign("Napisz po angielsku o wieży, która jest zamknięta w zimie.", "The tower is closed in winter.")


def test_length_is_no_limit():
    long = "I'm sorry, but I can't help with that. " * 60
    assert pairs.defect(Q, long.strip(), NONE) == "refusal"
    asked = "Please list " + ", ".join(f"thing{i}" for i in range(80)) + "."
    assert pairs.is_refusal("I can't provide " + " ".join(f"thing{i}" for i in range(80)) + ".", asked) and not pairs.is_refusal("I can't provide " + " ".join(f"thing{i}" for i in range(80)) + ".", Q)
    assert pairs.is_truncated("The tower (see " + "and so on " * 200, NONE)


def test_every_copy_comes_from_the_compression():
    for q in ("Hi?", "Why?", Q, ZH, Q * 40, "ab " * 100_000):
        for a in (q, q.upper(), q + "\n" + q, "Question: " + q, (q + " ") * 7):
            assert pairs.is_copy(q, a), (q[:20], a[:20])
        assert not pairs.is_copy(q, q + " Because of the ice on the stairs.")


def test_the_model_learns_what_ends_answers():
    ends = {("text", "full stop"): (900, 60), ("text", "words"): (20, 900), ("list", "entry"): (300, 40), ("text", "label"): (500, 30)}
    taught = pairs.Endings(np.zeros(pairs.BUCKETS, dtype=np.int64), np.zeros(pairs.BUCKETS, dtype=np.int64), ends)
    assert taught.breaks_off("text", "words", "tower") and not taught.breaks_off("text", "full stop", None)
    unpointed = pairs.Endings(taught.closes, taught.goes_on, {("text", "words"): (900, 60), ("text", "full stop"): (3, 2)})
    assert not unpointed.breaks_off("text", "words", "tower"), "answers that never have a full stop are whole without one"
    assert pairs.end_and_cut("a") == (("text", "label"), None) and pairs.end_and_cut("The tower is closed.")[1]


def test_unknown_labels_part_a_pair():
    assert pairs.split_pair("Mentee: a b\nMentor: c d\nMentee: e") == ("a b", " c d\nMentee: e")
    assert pairs.split_pair("no label here") == ("no label here", None)
