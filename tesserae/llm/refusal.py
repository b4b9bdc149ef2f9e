"""Refusals: an automaton over the parts a refusing sentence is made of, in seven languages.

Every sentence outside quotations and code is read once. An Aho-Corasick automaton finds
its parts (who speaks, a negated ability, a lack, evidence, an act of answering, an
apology ...), and the state is the set of parts met; a sentence refuses in the states that
``refusing`` names. No whole phrases are listed, so any wording from these parts is met.

An answer is a refusal where a sentence refuses, nothing of substance is said before it,
and no contrast after it brings the answer after all. Courtesy, apologies, and sentences
about the question or the evidence are no substance; code and quotations after a refusal
are no answer by themselves. Length and position do not matter otherwise.
"""

from __future__ import annotations

import functools
import re
import unicodedata

# Words that stand for each part, "_" for a blank; a final "*" allows any ending.
PARTS = {
    "self": "i me myself i'm i'd i'll i've we ich mir mich wir uns je j'ai j'* m'* nous moi yo nosotros я мне меня мы нам 我 我们 本人 私 当方 弊社",
    "model": "language_model ai_model ai_assistant assistant sprachmodell assistent modèle_de_langage assistant_virtuel modelo_de_lenguaje asistente языковая_модель ассистент 语言模型 助手 言語モデル アシスタント",
    "unable": "cannot can't can_not couldn't could_not unable not_able isn't_able aren't_able not_possible isn't_possible impossible not_in_a_position not_allowed not_permitted won't will_not would_not wouldn't not_going_to not_comfortable irresponsible incapable"
    " nicht_in_der_lage unmöglich außerstande nicht_möglich unverantwortlich nicht_imstande darf_nicht kann_nicht können_nicht lässt_sich_nicht lässt_sich_das_nicht lassen_sich_nicht"
    " pas_en_mesure incapable pas_possible pas_capable ne_peux ne_puis ne_peut ne_pouvons ne_saurais ne_permet* ne_me_permet* ne_nous_permet* pas_autorisé"
    " no_puedo no_podemos no_podría no_soy_capaz no_es_posible no_me_es_posible imposible incapaz no_estoy_en no_estamos_en no_puede no_se_puede"
    " не_могу не_можем не_смогу не_сможем невозможно не_в_состоянии не_удаётся не_удалось нельзя не_позволя* 无法 不能 没办法 没有办法 不可以 难以 不便 できません できかね 出来ません できない かねます 不可能 いたしかね 難しいです られません",
    "can": "kann können könnte dürfen darf possible can could may möglich peut peux puedo puede может могу можно",
    "ignorant": "don't_know do_not_know don't_really_know no_idea not_sure not_certain not_aware unaware have_no_view no_view_of no_access don't_have_access not_have_access no_knowledge no_way_to no_way_of no_means_of weiß_nicht weiss_nicht weiß_es_nicht weiß_das_nicht weiß_ich_nicht keine_ahnung keinen_zugriff keine_kenntnis ne_sais_pas aucune_idée ignore_si pas_accès"
    " no_sé no_lo_sé desconozco no_tengo_idea no_tengo_acceso no_conozco не_знаю не_знаем нет_доступа понятия_не_имею 不知道 不清楚 不了解 不确定 わかりません 分かりません 存じません 存じ上げません 不明です 把握しておりません",
    "lack": "no nobody no_one without lack lacks nothing none nowhere neither kein keine keinen keinem keiner keinerlei ohne nichts aucun aucune aucun* d'aucun sans rien pas_de pas_d' no_hay ningún ninguna ningun sin nada no_dispongo no_tengo no_cuento no_encuentro no_veo нет без ничего никак* 没有 并未 ありません ございません",
    "scarce": "not_enough insufficient* unavailable not_available haven't_enough haven't_got_enough don't_have_enough does_not_support do_not_support doesn't_support not_sufficient isn't_sufficient aren't_sufficient isn't_enough aren't_enough lacking missing too_little doesn't_contain does_not_contain don't_contain do_not_contain doesn't_mention does_not_mention don't_mention do_not_mention doesn't_say do_not_say don't_say does_not_say doesn't_tell do_not_tell don't_tell does_not_tell doesn't_reveal do_not_reveal does_not_show do_not_show don't_show doesn't_show doesn't_specify do_not_specify don't_specify never_mention*"
    " nicht_genug nicht_genügend nicht_ausreich* unzureichend* fehlt fehlen zu_wenig mangelt reicht_nicht reichen_nicht nicht_aus nicht_hervor"
    " pas_assez pas_suffi* insuffisant* manque* trop_peu ne_contien* ne_suffi* ne_mentionne* ne_précise* no_basta* no_contien* insuficiente* falta faltan carezco carece* no_figura* no_menciona* no_alcanza*"
    " недостаточно не_хватает отсутств* мало нехватк* не_содерж* не_упомина* 不足 缺乏 缺少 不够 未找到 找不到 不充分 不足以 未提及 没有提到 足りな* 足りません 見つかりません 見当たり 不十分 欠けて 十分な",
    "evidence": "evidence information context data detail details source sources support basis material excerpts excerpt grounds snippets retrieved documentation anything angaben informationen information belege beleg kontext daten hinweise hinweis grundlage quellen anhaltspunkte unterlagen auszüge auszügen ausschnitte* material"
    " informations information preuve preuves contexte données élément éléments indice indices sources extraits documents información prueba pruebas evidencia evidencias contexto dato datos elementos indicios fuentes fragmentos material"
    " данн* информаци* сведени* доказательств* контекст* источник* оснований фрагмент* материал* 证据 信息 资料 上下文 依据 数据 材料 内容 线索 情報 根拠 証拠 文脈 資料 データ 材料 手がかり",
    "act": "answer respond reply tell say determine help assist provide give comment discuss confirm explain find complete verify establish conclude judge guess speculate offer share decide infer look_into identify answered answering told determined established verified confirmed inferred conclusion conclusions go_on provided identified"
    " beantworten antworten sagen helfen bestimmen feststellen angeben bestätigen ermitteln nennen weiterhelfen auskunft beurteilen schließen klären erklären äußern spekulieren herausfinden"
    " répondre dire aider déterminer confirmer fournir indiquer préciser conclure affirmer donner trancher savoir spéculer commenter responder contestar decir ayudar* determinar confirmar proporcionar afirmar saber concluir especular indicar precisar opinar dar* establecer"
    " ответить отвечать сказать помочь определить подтвердить назвать судить установить дать объяснить обсуждать гадать комментировать 回答 答复 帮助 帮忙 提供 确定 判断 给出 说明 告诉 讨论 猜测 协助 答え* お答え 回答 お手伝い 判断 提供 確認 申し上げ お伝え お教え 推測 お力",
    "decline": "decline declines declining refuse refuses refrain abstain rather_not prefer_not outside_what beyond_what outside_my beyond_my turn_down turn_this pass_on not_something_i off_limits lehne lehnen verweigere verweigern verzichte verzichten enthalte ablehnen m'abstiens abstenir m'abstenir refuse décline déclinons préfère_ne_pas"
    " me_niego rechazo declino abstengo abstenerme prefiero_no отказыва* воздерж* отклоня* 拒绝 谢绝 不予 恕不 控え* お断り 差し控え* 遠慮",
    "reply": "answer answers response reply antwort antworten réponse réponses respuesta respuestas ответ ответа ответов 答案 回答 答复 お答え",
    "question": "question questions request ask asked asking frage fragen anfrage question demande pregunta preguntas solicitud consulta вопрос вопроса запрос запроса 问题 提问 質問 ご質問 お問い合わせ",
    "open": "unanswered remains_open remain_open stay_open stays_open unbeantwortet bleibt_offen offen_bleiben sans_réponse reste_ouverte sin_respuesta sin_responder без_ответа остаётся_открыт* 未能回答 没有答案 未解答 未回答",
    "sorry": "sorry apolog* regret regrettably unfortunately afraid sadly forgive excuse leider entschuldig* bedaure bedauere bedauerlicherweise tut_mir_leid désolé désolée malheureusement regrette navré pardon siento lamento lamentablemente desafortunadamente disculp* perdón сожалени* извин* простите увы 抱歉 对不起 遗憾 不好意思 申し訳 すみません 残念 恐れ入り 恐縮",
    "negated": "not no nothing never none cannot can't won't don't didn't doesn't couldn't wouldn't unable nicht kein keine nichts nie pas aucun aucune rien jamais no nada nunca не нет ничего ни 不 没 无 未 ません ない ず",
    "courtesy": "thank thanks hello hi dear great_question good_question happy_to glad_to appreciate welcome please understand hope let_me hmm danke hallo gerne gern verstehe merci bonjour volontiers comprends gracias hola gusto entiendo спасибо здравствуйте привет пожалуйста понимаю 谢谢 您好 你好 感谢 请 ありがとう こんにちは お願い お世話",
    "contrast": "but however still nevertheless yet although that_said instead aber jedoch dennoch trotzdem allerdings mais cependant toutefois néanmoins pero sin_embargo aunque но однако зато 但 但是 不过 然而 しかし ただし ですが",
}
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿]")
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`]*`?", re.S)
_NAMED = re.compile(r"\S*[/_\\]\S*|\b\w+\.\w+\b|\b\w*[a-z][A-Z]\w*")
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|«[^»\n]*»|「[^」\n]*」')
_SENTENCE = re.compile(r".+?(?:[.!?…](?=\s|$)|[。！？]|\n|\Z)", re.S)
_CLAUSE = re.compile(r"[,;:，；、—–]\s*|\s-\s")
_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
#: What stands for code in the text that is read: a sign that no part holds.
MARK = "\x01"


@functools.lru_cache(1)
def _automaton():
    """All parts by their spellings; a spelling may stand for several parts."""
    import ahocorasick

    found: dict[str, list[tuple[str, bool]]] = {}
    for part, listed in PARTS.items():
        for word in listed.split():
            found.setdefault(word.rstrip("*").replace("_", " "), []).append((part, word.endswith("*")))
    automaton = ahocorasick.Automaton()
    for word, parts in found.items():
        automaton.add_word(word, (word, tuple(parts)))
    automaton.make_automaton()
    return automaton


def parts_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """Each part met in a text of lower case, with the places of its longest spellings."""
    met: dict[str, list[tuple[int, int]]] = {}
    for last, (word, parts) in _automaton().iter(text):
        begin, end = last + 1 - len(word), last + 1
        if not _UNSPACED.search(word):
            if begin and (text[begin - 1].isalnum() or text[begin - 1] in "'_"):
                continue
            whole = end == len(text) or not (text[end].isalnum() or text[end] == "_" or (text[end] == "'" and not word.endswith("'")))
        else:
            whole = True
        for part, open_end in parts:
            if whole or open_end:
                met.setdefault(part, []).append((begin, end))
    return met


def refusing(met: dict, text: str) -> bool:
    """Whether a sentence of these parts declines, or says that there is no ground for an answer."""
    has = met.__contains__
    speaks, excuses = has("self") or has("model"), has("sorry")
    plain = MARK not in text
    about = has("reply") or has("question") or has("act")
    lacks = has("lack") or has("scarce")
    if has("unable") and about and (speaks or excuses or has("reply") or has("question") or has("evidence")):
        return not has("self") or excuses or plain or _near(met, "unable", "self", 60)
    if has("unable") and ((speaks and (plain or has("evidence"))) or (excuses and plain)):
        return True
    if has("ignorant") and (speaks or excuses or plain):
        return True
    if has("decline") and (speaks or excuses or ((has("reply") or has("question") or has("act")) and plain)):
        return True
    if has("open") and (has("reply") or has("question") or plain):
        return True
    if has("scarce") and has("evidence") and (about or speaks or excuses or plain):
        return True
    if lacks and has("evidence") and (speaks or excuses or ((has("act") or has("can")) and plain)):
        return True
    if lacks and has("reply") and _near(met, "lack", "reply", 3) and (speaks or plain):
        return True
    if excuses and has("negated") and (about or has("evidence") or has("can")) and plain:
        return True
    # in the first person, what is negated is what the speaker can or knows
    return speaks and has("negated") and (about or has("evidence") or has("can") or has("unable") or lacks)


def _near(met: dict, a: str, b: str, most: int) -> bool:
    """Whether a part of kind ``a`` stands before one of kind ``b``, or after it, with at most ``most`` signs between."""
    return any(-1 <= y[0] - x[1] <= most or -1 <= x[0] - y[1] <= most for x in met.get(a, ()) for y in met.get(b, ()))


def plain_text(answer: str) -> str:
    """An answer in lower case without quotations, each piece of code and each name from code as one mark."""
    text = unicodedata.normalize("NFKC", answer).replace("’", "'")
    return _NAMED.sub(MARK, _QUOTED.sub(" ", _CODE.sub(MARK, text))).lower()


def refuses(answer: str) -> bool:
    """Whether an answer refuses."""
    sentences = (m.group() for m in _SENTENCE.finditer(plain_text(answer)) if m.group().strip())
    for sentence in sentences:
        clauses = _clauses(sentence)
        refused = [k for k, (clause, _) in enumerate(clauses) if refusing(parts_of(clause), clause)]
        if refused or refusing(parts_of(sentence), sentence):
            first = refused[0] if refused else len(clauses)
            if refused and any(MARK in c and _tells(parts_of(c), c) for c, _ in clauses[:first]):
                return False
            later = [(c, begins) for c, begins in clauses[first + 1 :]] + [(s, _begins(s)) for s in sentences]
            return not any(begins and MARK in c and not refusing(parts_of(c), c) for c, begins in later)
        if _tells(parts_of(sentence), sentence) or any(MARK in c and _tells(parts_of(c), c) for c, _ in clauses):
            return False
    return False


def _begins(text: str) -> bool:
    """Whether a text begins with a word of contrast."""
    return any(not _LETTERS.search(text[:b]) for b, _ in parts_of(text).get("contrast", ()))


def _clauses(sentence: str) -> list[tuple[str, bool]]:
    """Clauses of a sentence, each with whether it begins with a word of contrast."""
    return [(c, _begins(c)) for c in _CLAUSE.split(sentence) if c.strip()]


def _tells(met: dict, text: str) -> bool:
    """Whether a sentence states something that is neither courtesy nor about the question."""
    if any(p in met for p in ("courtesy", "sorry", "self", "model", "reply", "question", "ignorant", "decline")) or text.rstrip().endswith(("?", "？")):
        return False
    named = MARK in text
    count = len(_LETTERS.findall(text)) if not _UNSPACED.search(text) else len(re.sub(r"\W", "", text)) // 2
    return count + 2 * named >= 4 and not (("lack" in met or "scarce" in met) and "evidence" in met)
