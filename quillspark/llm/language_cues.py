"""Fixed word lists for telling languages and refusals apart. All words are folded (lower case, no accents)."""

from __future__ import annotations

import re

from quillspark.functions.folding import fold

# fixed values: frequent function words by language
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as was at by be this which or from but not are have an they you we their has its were been will would can when after before during until while so all must".split(),
    "pt": "o a os as do da dos das no na nos nas em um uma de que e para com por nao se ao aos mas mais como quando ja agora foi ser tem sao sua seu isso essa esse nossa nosso depois antes ate sob sem durante desde enquanto deve nada voce".split(),
    "es": "el la los las del al en un una de que y para con por no se lo mas como cuando ya fue ser tiene son su esto esta este nuestra nuestro despues antes hasta bajo sin durante desde mientras debe nada tras si hay muy cada".split(),
    "fr": "le la les l d du des de en un une et que qui pour avec par ne pas se au aux mais plus comme quand est ete etre sont son sa ce cette ces notre nos apres avant jusqu sous sans pendant depuis tant doit rien dans sur si il elle chaque".split(),
    "de": "der die das den dem des ein eine einen einem einer und zu in ist nicht mit auf fur von im am als auch es an werden aus er hat dass sie nach bei um noch wie uber so zum zur wenn nur bis vor ohne unter wahrend seit muss jetzt".split(),
    "it": "il lo la gli le di del della dei delle che e per con non si un una in nel nella ma come quando piu dopo prima fino senza durante mentre deve sono era".split(),
}
ONLY = {}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in _ws:
        ONLY.setdefault(_w, set()).add(_l)

_SCRIPTS = [
    ("ja", re.compile(r"[぀-ヿ]")),
    ("zh", re.compile(r"[一-鿿]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("ar", re.compile(r"[؀-ۿ]")),
    ("ko", re.compile(r"[가-힯ᄀ-ᇿ]")),
    ("el", re.compile(r"[Ͱ-Ͽ]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
]
_LATIN = re.compile(r"[a-z]")
_IDENTIFIER = re.compile(r"\S*[/_`=\d@<>]\S*|\b\w+\.\w+\b|\"[^\"]*\"")
_WORDS = re.compile(r"[^\W\d_]+")


def prose_words(folded: str) -> list[str]:
    """The words of a folded text outside identifiers, paths, numbers and quotations."""
    return _WORDS.findall(_IDENTIFIER.sub(" ", folded))


def guess_language(folded: str) -> tuple[str | None, float]:
    """(language, score): by script, else by function words weighted by how few languages share them."""
    prose = _IDENTIFIER.sub(" ", folded)
    latin = len(_LATIN.findall(prose))
    for name, pat in _SCRIPTS:
        n = len(pat.findall(prose))
        if n >= 4 and n * 2 > latin:
            return name, float(n)
    score: dict[str, float] = {}
    for w in _WORDS.findall(prose):
        langs = ONLY.get(w)
        if langs:
            for l in langs:
                score[l] = score.get(l, 0.0) + 1.0 / len(langs)
    if not score:
        return None, 0.0
    best = max(score, key=lambda l: (score[l], l))
    return best, score[best]


# fixed values: ways to decline a task, over folded text with apostrophes as spaces
_REFUSALS = (
    r"\b(?:"
    # English
    r"(?:can ?not|can t|could not|unable to|not able to|won t be able to|not going to|will not|won t|not in a position to|do not|don t|refuse to|decline to|must refuse to|not comfortable)\s(?:\w+ ){0,3}?(?:help|assist|compress|summari[sz]e|comply|answer|respond|fulfil|fulfill|process this|do this|do that|do so|provide|complete|continue|produce|shorten|translate|work on|support|engage|share|create|generate|handle)"
    r"|(?:something|a request|a task|one) (?:that )?i (?:won t|will not|can t|cannot) (?:do|take|answer|help)"
    r"|against my (?:guidelines|policy|policies|rules|principles|instructions)"
    r"|(?:must|have to|need to|going to) (?:decline|refuse|pass on)|i (?:decline|refuse)\b"
    r"|outside (?:of )?what i (?:am|m) (?:allowed|permitted|able)|not (?:allowed|permitted|authori[sz]ed) to|(?:would|d) rather not|prefer not to"
    r"|not something i can|(?:ai|language) model,? (?:and )?i"
    # Portuguese
    r"|nao (?:posso|consigo|poderei|sou capaz de|estou em condicoes de|estou autorizado a|vou|devo) (?:\w+ ){0,2}?(?:ajudar|resumir|responder|atender|cumprir|comprimir|fazer isso|processar|produzir|continuar|auxiliar|colaborar|fornecer|traduzir|realizar|encurtar|gerar)"
    r"|nao tenho permissao|nao me e permitido|contra (?:as )?minhas (?:diretrizes|regras|politicas)|(?:preciso|tenho de|tenho que|devo) (?:recusar|declinar)|recuso me|prefiro nao|fora do que me e permitido|nao (?:produzo|faco|respondo|escrevo|resumo)\b"
    # Spanish
    r"|no (?:puedo|podre|soy capaz de|estoy autorizad[oa] a|me es posible|voy a|debo) (?:\w+ ){0,2}?(?:ayudar|ayudarte|ayudarle|resumir|responder|atender|cumplir|comprimir|hacer eso|hacer esto|procesar|producir|continuar|asistir|proporcionar|traducir|realizar|generar)\w*"
    r"|no tengo permiso|no (?:me )?esta permitido|contra mis (?:directrices|normas|politicas|reglas|pautas)|(?:debo|tengo que) (?:rechazar|negarme|declinar)|prefiero no|fuera de lo que (?:se me|me) (?:permite|esta permitido)|no (?:produzco|hago|respondo|escribo) "
    # French
    r"|(?:ne (?:peux|puis|pourrai|suis|dois)|n ai) pas (?:\w+ ){0,4}?(?:aider|resumer|repondre|acceder|compresser|faire (?:cela|ca)|traiter|produire|continuer|assister|fournir|traduire|satisfaire|autorise|mesure|droit|permission|le droit)"
    r"|contre mes (?:directives|regles|principes|consignes)|(?:dois|suis oblige de) (?:refuser|decliner)|prefere ne pas|en dehors de ce qui m est permis|contraire a mes"
    # German
    r"|(?:kann|konnte|darf|werde|mochte) (?:\w+ ){0,6}?nicht (?:\w+ ){0,4}?(?:helfen|zusammenfassen|beantworten|antworten|unterstutzen|bearbeiten|erfullen|nachkommen|komprimieren|weitermachen|ubersetzen|tun|machen|kurzen)"
    r"|gegen meine (?:richtlinien|regeln|grundsatze|vorgaben)|muss (?:\w+ ){0,4}?ablehnen|lieber nicht|nicht in der lage|nicht (?:erlaubt|gestattet|befugt)|lehne (?:\w+ ){0,3}ab"
    # Italian
    r"|non (?:posso|riesco a|sono in grado di) (?:\w+ ){0,2}?(?:aiutar\w*|riassumere|rispondere|fare|elaborare)|contro le mie linee guida|devo rifiutare"
    r")"
    # Russian, Arabic, Japanese, Chinese
    r"|не (?:могу|смогу|буду|имею права|в состоянии) (?:\w+ ){0,3}?(?:помочь|ответить|выполнить|обработать|сократить|кратко|пересказать|сделать|продолжить|помогать|отвечать|сжать)|вынужден\w* отказат|противоречит моим|мне не разрешено|не разрешается|отказываюсь"
    r"|لا (?:استطيع|أستطيع|يمكنني|اقدر|أقدر)|لست قادر|يتعارض مع|اعتذر عن|أعتذر عن|غير مسموح لي|يجب ان ارفض|يجب أن أرفض"
    r"|お(?:手伝い|答え|応え|力に).{0,8}(?:できません|なれません)|(?:要約|対応|回答|処理|圧縮).{0,6}(?:できません|できかねます|いたしかねます)|ガイドラインに反|お断り|許可されていません"
    r"|(?:无法|不能|没法|不便)(?:为您|为你|帮助|帮您|帮你|协助|处理|回答|提供|完成|总结|压缩|满足|继续)|违反我的|拒绝|不被允许|抱歉.{0,6}(?:无法|不能)"
)
REFUSALS = re.compile(fold(_REFUSALS))
