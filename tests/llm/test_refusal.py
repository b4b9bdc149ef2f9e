"""Refusals in wordings that stand in no list, and answers that only use their words."""

import pytest

from tesserae.llm import pairs, refusal

REFUSALS = (
    "I would love to help, but nothing in these files says who maintains the parser.",
    "Honestly, the snippets do not tell us when this was introduced, so any reply would be a guess on my part.",
    "That is beyond my remit, so I shall pass on it.",
    "Thank you for the question. I understand it matters to you. I have to turn this request down.",
    "Based on what was retrieved, it can't be determined where the lock is released.",
    "We lack the context needed to answer.",
    "I don't have enough context to give you a reliable answer.",
    "There isn't sufficient information here to say.",
    "I must respectfully decline. The repository holds parsers. It also holds scanners. Neither is related. Please consult the manual.",
    "I'm not comfortable answering that.",
    "Apologies, but this cannot be answered from the given excerpts.\n```\ngrep -r foo .\n```",
    "Dazu liegen mir keine Informationen vor.",
    "Ich bin nicht in der Lage, diese Frage zu beantworten.",
    "Aus den Auszügen lässt sich das nicht ermitteln.",
    "Es tut mir leid, aber darauf habe ich keine Antwort.",
    "Ohne weitere Angaben kann ich dazu nichts sagen.",
    "Je n'ai pas assez d'informations pour répondre.",
    "Il m'est impossible de me prononcer sur ce point.",
    "Le contexte fourni ne suffit pas pour répondre à cette question.",
    "Malheureusement, je ne dispose d'aucun élément à ce sujet.",
    "No tengo suficiente información para contestar.",
    "Lamentablemente, el contexto no permite dar una respuesta.",
    "No me es posible ayudarle con esa consulta.",
    "Desconozco la respuesta a esta pregunta.",
    "У меня нет достаточной информации, чтобы ответить.",
    "К сожалению, в предоставленных фрагментах ответа нет.",
    "Я не в состоянии помочь с этим запросом.",
    "Невозможно определить это по приведённому контексту.",
    "根据提供的内容，我没有办法回答。",
    "很遗憾，资料中没有相关信息。",
    "我不清楚这个问题的答案。",
    "上下文不足以回答该问题。",
    "恐れ入りますが、この件についてはお答えしかねます。",
    "提供された資料からは判断できません。",
    "申し訳ございませんが、十分な情報がありません。",
    "その質問には答えられません。",
    "Nobody could say from these excerpts.",
    "I am going to leave this one alone, as I have no basis for an answer.",
    "We regret that we cannot comment on internal matters.",
    "The provided context is silent on this point, so I can't confirm it.",
    "It would be irresponsible of me to guess.",
    "That information is unavailable to me.",
    "The evidence does not support any conclusion here.",
    "Diese Frage muss leider offen bleiben.",
    "Hierzu finde ich keine Belege im Kontext.",
    "Darüber darf ich keine Auskunft geben.",
    "Cette information n'apparaît pas dans les extraits, je ne peux donc rien affirmer.",
    "Je préfère ne pas spéculer là-dessus.",
    "Me temo que no puedo ofrecer una respuesta fiable.",
    "Боюсь, по этим данным ничего определённого сказать нельзя.",
    "Я не располагаю сведениями об этом.",
    "这个问题超出了我的能力范围，我无法给出回应。",
    "由于缺少上下文，暂时不能判断。",
    "この情報だけでは判断しかねます。",
    "申し訳ありません、詳細は把握しておりません。",
)
ANSWERS = (
    "It is set in `core/limits.py`; callers cannot change it later.",
    "No. The scanner does not read hidden files unless `--all` is given.",
    "`LineIndex` returns nothing when no data is given.",
    "The request is declined by `AccessPolicy` when the path has no details section.",
    "The parser refuses files without a source and reports no context.",
    "You can't call it twice. The second call is unable to load the module.",
    "The limit is 5, set in `x/y.py`. I cannot tell why it was chosen.",
    "Nothing is cached: every question is answered from the index in `a/b.c`.",
    "Der Parser liest keine Daten, wenn `limit` fehlt.",
    "La fonction ne peut pas être appelée deux fois, voir `a/b.py`.",
    "La caché no contiene datos hasta que `load` termina.",
    "Функция не читает данные, если `limit` не задан.",
    "该函数在没有数据时返回空列表。",
    "`load` が終わるまでデータはありません。",
    "I can't show the whole file, but `parse_row` in `io/rows.py` does it.",
    "The answer is cached in `store.py`, so no question is asked twice.",
    "It never answers a question without evidence; see `gate.cpp`.",
    "Sorry for the delay. It is defined in `a.py`.",
    "The evaluator treats a missing score as zero and moves on.",
    "Sin embargo, `load` no lee datos vacíos y devuelve una lista.",
    "Wenn keine Daten da sind, gibt `read` eine leere Liste zurück.",
    "Le module lit les données sans source externe.",
    "No data is lost because `flush` runs first.",
    "This cannot happen: `check` runs before the parse.",
    "The error means that the context is missing in `cfg.toml`.",
    "函数不能在循环中调用。",
    "`parse` は空の入力を処理できません。",
)


@pytest.mark.parametrize("text", REFUSALS)
def test_refusals(text):
    assert refusal.refuses(text)


@pytest.mark.parametrize("text", ANSWERS)
def test_answers(text):
    assert not refusal.refuses(text)


def test_place_and_length_do_not_matter():
    padding = "Thank you for asking. I understand that this matters to you. "
    long = " ".join(f"The repository also holds module number {i} of its kind." for i in range(40))
    assert refusal.refuses(padding + "Sadly I cannot answer this. " + long)
    assert refusal.refuses("I can't answer that.\n```\ngrep -rn limit .\n```")
    assert not refusal.refuses(long + " I cannot answer the rest.")
    assert pairs.defect("Where is `x`?", padding + "We are unable to answer this question.") == "refusal"
    assert not refusal.refuses('It prints "I cannot answer that" and stops.') and not refusal.refuses("") and not refusal.refuses("`I cannot answer`")
    assert not refusal.refuses("I cannot list all of it, but `load_rows` is the one you want.")
