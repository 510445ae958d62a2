"""Refusal automata: cue phrases of a language found in one pass, then bounded gaps between them.

All phrases of a language form one Aho-Corasick automaton, so a text is read
once however many phrases there are. A rule is a sequence of classes of
phrases with the largest gap between one and the next; it holds if its classes
follow one another within their gaps. Nothing backtracks: time is linear in the
text and in the number of phrases found.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import product

import ahocorasick

from .visual import visual_form

# How answers decline or say that nothing is said, by language. In a rule, alternatives are parted by "|",
# "{a,b}" stands for either, "~40" is a gap of up to 40 characters, "~3w" one of up to 3 words with nothing but spaces
# between them, "*" the beginning of a word, and "$" the end of the clause.
REFUSALS = {
    "en": [
        "can not|cannot|can't|could not|couldn't|unable to|not able to|am not in a position to|not possible to|impossible to ~3w "
        "answer*|determine*|establish*|find*|help*|provide*|give*|say*|tell*|locate*|comment*|advise*|confirm*|identify*|assist*|see*|conclude*|respond*|comply*|share*|offer*|state*",
        "{decline,declined,refuse,refused} to {answer,comment,respond,say} $",
        "must decline|have to decline|I'd rather not|I would rather not|would prefer not to|not {going,willing,allowed,permitted} to {answer,comment,give,say}*",
        "no answer|not enough information|insufficient {information,data,detail}*|not stated|"
        "not {covered,mentioned,addressed,specified,contained,included,disclosed,given,found,available,clear,provided,answered,dealt with,regulated,settled,set out}",
        "{say,says,contain,contains,give,gives,offer,offers,provide,provides,mention,mentions,reveal,reveals,state,states,hold,holds,include,includes} "
        "{nothing,no information,no detail,no details,no answer,no indication,no mention,no clue,no guidance,no rule,no clause,no such}",
        "{is,are,remain,remains,stay,stays} {silent,unclear,open}",
        "no {mention,mentions,information,detail,details,indication,indications,clause,clauses,passage,passages,provision,provisions,section,sections,excerpt,excerpts,source,sources,text,texts} ~60 "
        "settle|settles|addresses|cover|covers|speak|speaks|deal|deals|mention|mentions|given|found|about|on|of|regarding|here|state|states|answer|answers|say|says|regulate|regulates|tell|tells",
        "none of the ~50 address*|cover*|mention*|speak*|deal*|state*|say*|settle*|answer*|tell*",
        "nothing ~50 address*|cover*|mention*|speak*|deal*|state*|say*|settle*|answer*|about*|on*|tell*",
        "{do,does} not {mention,say,state,cover,address,contain,tell,specify,answer,settle,deal,speak,give,provide,allow,let,reveal,include,indicate,show,disclose,make clear}*",
        "doesn't {mention,say,state,cover,address,contain,tell,specify,answer}*|{don't,do not} {know,have,see,find}*|don't {mention,say,cover,contain}*",
        "will not guess|have to leave this open|speak to your lawyer|ask a lawyer|not give advice|not give legal advice|I have no",
    ],
    "de": [
        "kann|können|konnte|konnten|darf|dürfen|möchte|will|werde ~70 nicht|kein{,e,er,en,em,es}|nichts ~70 "
        "beantwort*|antwort*|auskunft*|sagen*|finden*|feststell*|ermitt*|angaben*|geben*|helfen*|äußern*|bestimm*|mitteil*|entnehm*|nennen*|klären*|beurteil*|ersehen*",
        "leider|bedauere|bedaure ~60 nicht|kein{,e,er,en,em,es}|nichts",
        "tut mir leid|muss ich ablehnen|muss ich passen",
        "lehne ~30 ab",
        "steht|sagt|sagen|enthält|enthalten|findet sich|finde|finden sich|geben|gibt|nennt|nennen|liefern|liefert|lässt sich|lassen sich|regelt|regeln|klärt|klären|behandelt|behandeln|"
        "erwähnt|erwähnen|äußert sich|äußern sich|beantwortet|ist|sind|geht|ergibt sich ~60 nichts|"
        "nicht {ersichtlich,erkennbar,enthalten,genannt,geregelt,erwähnt,angegeben,beantworten,ermitteln,entnehmen,feststellen,bestimmen,klären,hervor,behandelt,beantwortet,zu}|"
        "kein{,e,er,en,em,es} {angabe,angaben,auskunft,hinweis,hinweise,regelung,aussage,aussagen,antwort,information,informationen,stelle,klausel,passage}",
        "kein{,e} {antwort,angabe,angaben,auskunft,informationen,aussage,stelle,passage,abschnitt,der stellen,der passagen,textstelle,klausel,der auszüge,der quellen,hinweis,hinweise}|keiner der|keines der|"
        "nicht ersichtlich|offen bleibt|bleibt offen|bleibt unklar|unklar bleibt|daher gebe ich keine|nichts {über,zu,zur,zum}|nicht genug|zu wenig",
        "reicht|reichen ~40 nicht aus",
        "nicht {beantworten,möglich,sagen,helfen,angegeben,geregelt,erwähnt,genannt,entnehmen}|fragen sie einen anwalt|fragen sie bitte einen anwalt",
    ],
    "fr": [
        "ne|n'* ~42 peux|peut|pouvons|puis|permet|permettent|saurais|trouve|trouvons|dit|disent|contient|contiennent|donne|donnent|mentionne|mentionnent|précise|précisent|traite|traitent|aborde|abordent|"
        "répond|répondent|figure|ressort|règle|évoque|évoquent|suffit|suffisent|suis|dispose|indique|indiquent|parle|parlent|est|sont|souhaite|éclaire|éclairent|couvre|couvrent ~50 "
        "pas|rien|aucun|aucune|point|donc",
        "rien|aucun|aucune ~60 ne|n'*",
        "impossible ~40 répondre*|renseigner*|dire*|déterminer*|établir*|conclure*|donner*|trouver*|savoir*|préciser*",
        "m'est impossible|il est impossible|regrette|désolé|désolée|pas assez d'*|information insuffisante|informations insuffisantes|reste {ouvert,ouverte,incertain,incertaine,flou,floue,obscur,obscure}|"
        "sans réponse|silencieux|muet sur|muets sur|refuse de|ne trouve rien|je dois décliner|je dois refuser|ne traite|préfère ne pas",
        "ne ~12 aucune {information,réponse,précision,indication}",
    ],
    "es": [
        "no ~30 puedo|puede|podemos|es posible|me es posible|encuentro|encontré|encuentra|consta|constan|dice|dicen|contiene|contienen|aparece|aparecen|menciona|mencionan|aclara|aclaran|indica|indican|figura|figuran|"
        "hay|tengo|dispongo|permite|permiten|se {indica,menciona,dice,puede,aclara,especifica,desprende,encuentra,trata}|trata|tratan|responde|responden|especifica|especifican|ofrece|ofrecen|da|dan|resuelve|basta|bastan|"
        "quiero|deseo|sé|he podido|he encontrado|logro|existe|existen|queda claro|está claro|habla|hablan",
        "lo siento|lamento|lamentablemente|desconozco|queda abiert*|quedan abiert*|queda sin*|quedan sin*|sin respuesta|nada {sobre,dice,se dice,aclara,permite,en}|datos suficientes|debo {declinar,rechazar}|"
        "guarda silencio|guardan silencio|prefiero no",
        "imposible ~40 responder*|decir*|determinar*|saber*|contestar*",
        "ning{ún,una,uno} ~60 trata*|dice*|aclara*|menciona*|responde*|aborda*|habla*|regula*|resuelve*|contiene*|explica*",
    ],
    "ru": [
        "не ~30 могу|может|можем|удалось|удаётся|удается|вправе|готов|готова|буду|хочу ~60 ответить|отвечать|ответа|найти|определить|установить|сказать|дать|предоставить|помочь|комментировать|прокомментировать|сообщить|указать",
        "невозможно ~40 ответить|определить|установить|сказать|найти|дать",
        "не {указано,указан,указана,указаны,упоминается,упоминаются,упомянуто,сказано,говорится,содержится,содержит ответа,содержат ответа,содержит информации,содержат информации,содержит сведений,содержат сведений,"
        "регулируется,раскрывается,приводится,найдено,найдена,ясно,установлено,знаю}",
        "нет {ответа,информации,сведений,данных,указаний,упоминания,ясности}|недостаточно {информации,сведений,данных}|ничего не {сказано,говорится,указано,говорит,говорят}|ничего не сказано|"
        "к сожалению ~60 не|нет",
        "вынужден отказаться|вынуждена отказаться|отказываюсь отвечать|воздержусь от ответа|обратитесь к юристу|остаётся неясным|остается неясным|остаётся открытым|остается открытым",
    ],
    "zh": [
        "无法|不能|未能|不便|难以 ~20 回答|确定|判断|提供|答复|找到|给出|得知|说明|作答|确认",
        "没有|未|并未|并没有|未曾|不 ~12 提及|提到|说明|规定|涉及|载明|回答|答案|相关信息|相关内容|包含|给出|写明|约定",
        "没有答案|信息不足|资料不足|不清楚|不得而知|恕难|抱歉，无|拒绝回答|不予回答|请咨询律师",
    ],
    "ja": [
        "お答えできません|答えられません|回答できません|回答できかねます|お答えできかねます|答えることはできません|回答を控え|回答いたしかねます|お答えいたしかねます|わかりません|分かりません|不明です|判断できません|"
        "確認できません|特定できません|見つかりません|見つかりませんでした|見当たりません|情報がありません|情報が不足|記載がありません|記載はありません|記載されていません|書かれていません|述べられていません|"
        "触れられていません|言及されていません|言及がありません|定められていません|示されていません|含まれていません|規定がありません|弁護士にご相談",
    ],
    "hi": [
        "उत्तर|जवाब|जानकारी|सहायता|मदद ~40 नहीं",
        "नहीं {दे सकता,दे सकती,बता सकता,बता सकती,बताया,बताता,बताते,कहा,कहता,कहते,मिला,मिली,मिलता,मिलती,दिया,दी गई,लिखा,है कि,पता}",
        "कोई {उल्लेख,जानकारी,उत्तर,जवाब,विवरण} नहीं|उल्लेख नहीं|स्पष्ट नहीं|पर्याप्त नहीं|पर्याप्त जानकारी नहीं|असमर्थ|खेद ~40 नहीं|असंभव",
    ],
    "ar": [
        "لا|لم|لن|لست ~30 يمكنني|أستطيع|أتمكن|يمكن|نستطيع|قادرا|أقدر ~50 الإجابة|الرد|تحديد|العثور|تقديم|إعطاء|القول|معرفة|المساعدة|التعليق",
        "لا {يذكر,تذكر,يتضمن,تتضمن,يحتوي,تحتوي,يوضح,توضح,يحدد,تحدد,ينص,تنص,يتناول,تتناول,يشير,تشير,يقول,تقول,يجيب,تجيب,توجد,يوجد,أعرف,أعلم}|لم {يذكر,تذكر,يرد,ترد,يحدد,تحدد,أجد,نجد}",
        "لا إجابة|غير {مذكور,مذكورة,محدد,محددة,واضح,واضحة,متوفرة,متاح,كافية,منصوص}|يتعذر|تعذر|أعتذر|آسف|ليس هناك|ليست هناك|استشر محاميا|لا معلومات",
    ],
    "th": [
        "ไม่สามารถ|ไม่อาจ|มิอาจ ~30 ตอบ|ระบุ|บอก|ให้|หา|ช่วย|ยืนยัน|สรุป|แสดง",
        "ไม่ได้|ไม่มี|มิได้ ~20 ระบุ|กล่าวถึง|ข้อมูล|คำตอบ|พูดถึง|บอก|กำหนด|แสดง|อธิบาย|รายละเอียด|เขียน",
        "ไม่พบ|ไม่ทราบ|ไม่ชัดเจน|ข้อมูลไม่เพียงพอ|ขออภัย|ขอไม่ตอบ|ปฏิเสธที่จะตอบ|โปรดปรึกษาทนาย",
    ],
}
# Words after which an answer is given all the same.
TURNS = {
    "en": "however|but|nevertheless|nonetheless|still,|yet|that said|although|though", "de": "jedoch|aber|allerdings|dennoch|doch|gleichwohl|trotzdem",
    "fr": "cependant|mais|toutefois|néanmoins|pourtant|or", "es": "sin embargo|pero|no obstante|aunque|con todo", "ru": "однако|но|тем не менее|зато",
    "zh": "但是|但|不过|然而", "ja": "しかし|ただし|もっとも、", "hi": "लेकिन|परंतु|परन्तु|किंतु|किन्तु|हालांकि", "ar": "لكن|غير أن|إلا أن", "th": "แต่|อย่างไรก็ตาม",
}
#: Scripts written without spaces, where a phrase needs no word boundary.
UNSPACED = frozenset({"zh", "ja", "th"})


def fold(text: str) -> str:
    """The form phrases and answers are compared in; curly apostrophes become straight ones."""
    return visual_form(text, True, False).replace("’", "'")


def _phrases(alternatives: str) -> list[str]:
    out = []
    for a in alternatives.split("|"):
        parts = [p[1:-1].split(",") if p[:1] == "{" else [p] for p in re.split(r"(\{[^}]*\})", a.strip())]
        out += ["".join(p) for p in product(*parts)]
    return out


class PhraseAutomaton:
    """Rules (sequences of phrase classes with gaps) over one Aho-Corasick automaton."""

    def __init__(self, rules: list[str], spaced: bool = True) -> None:
        self.spaced, self.rules, of = spaced, [], {}
        for r, rule in enumerate(rules):
            ends = rule.endswith("$")
            steps = re.split(r"\s~(\d+w?)\s", rule.removesuffix("$").strip())
            self.rules.append(([(int(g.rstrip("w")), g.endswith("w")) for g in steps[1::2]], ends))
            for n, alternatives in enumerate(steps[::2]):
                for p in _phrases(alternatives):
                    of.setdefault(fold(p.rstrip("*")), set()).add((r, n, p.endswith("*")))
        self.auto = ahocorasick.Automaton()
        for phrase, uses in of.items():
            self.auto.add_word(phrase, (len(phrase), tuple(sorted(uses))))
        self.auto.make_automaton()

    def find(self, s: str) -> tuple[int, int] | None:
        """(start, end) of the rule that begins first, the shortest of those; None if no rule holds."""
        hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for last, (size, uses) in self.auto.iter(s):
            a, b = last - size + 1, last + 1
            if self.spaced and a and s[a - 1].isalnum() and s[a].isalnum():
                continue
            whole = not (self.spaced and b < len(s) and s[b].isalnum() and s[b - 1].isalnum())
            for r, n, prefix in uses:
                if whole or prefix:
                    hits.setdefault((r, n), []).append((a, b))
        best = None
        for r, (gaps, ends) in enumerate(self.rules):
            reach = [(a, b, a) for a, b in hits.get((r, 0), ())]
            for n, (gap, words) in enumerate(gaps, 1):
                if not reach:
                    break
                then = hits.get((r, n), ())
                reach = [(x, y, start) for _, b, start in reach for x, y in then if self._near(s, b, x, gap, words)]
            for _, b, start in reach:
                if ends and not (len(s) - b <= 4 or any(c in ";.,:" for c in s[b : b + 5])):
                    continue
                if best is None or (start, b) < best:
                    best = (start, b)
        return best

    @staticmethod
    def _near(s: str, b: int, x: int, gap: int, words: bool) -> bool:
        if x < b or (not words and x - b > gap):
            return False
        between = s[b:x]
        return not words or (len(between.split()) <= gap and all(c.isalnum() or c in " _" for c in between))


@cache
def refusal_automaton(lang: str) -> PhraseAutomaton:
    return PhraseAutomaton(REFUSALS[lang], lang not in UNSPACED)


@cache
def turn_automaton(lang: str) -> PhraseAutomaton:
    return PhraseAutomaton([TURNS[lang]], lang not in UNSPACED)


def first(of, langs: tuple[str, ...], s: str) -> tuple[int, int] | None:
    """The first match of any of the languages' automata."""
    found = [m for k in langs if (m := of(k).find(s))]
    return min(found) if found else None
