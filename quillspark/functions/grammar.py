"""Patterns, word lists and formats that results depend on.

They state the data format (which spans are anchors, which words are fillers, which
phrases name status) and have to stay as they are for results to agree.
"""

from __future__ import annotations

import re

TOKEN = r"\w+(?:[-']\w+)*|https?://\S+|`[^`]*`"

# fixed values: words and phrases that change the meaning of their sentence, by family
RISK = (
    r"\b(?:não|nunca|jamais|sem|deve|devem|precisa|precisam|obrigatório|proibido"
    r"|not|never|no|without|must|shall|required|require(?:s|d|ments?)?|should|cannot|can't|don't|won't"
    r"|request|question|allowed|permit|permitted|forbidden|override"
    r"|solicitud|pregunta|nunca|sin|debe|permitido|permitida|prohibido|prohibida|prevalecen"
    r"|demande|question|jamais|sans|doit|autorisé|autorisée|interdit|interdite|priment"
    r"|auftrag|frage|niemals|nicht|ohne|muss|erlaubt|verboten|vorrang"
    r"|запрос|вопрос|никогда|не|без|должен|разрешена|разрешено|запрещено|безопасности|важнее"
    r"|طلب|سؤال|لا|دون|يجب|يسمح|ممنوع|أمان|تتقدم"
    r"|rejected|refused|reverted|superseded|failed|pending|blocked|warning|security"
    r"|rejet\w*|refus\w*|annul\w*|échou\w*|attente|bloqu\w*"
    r"|abgelehnt|verweigert|rückgängig|fehlgeschlagen|ausstehend|blockiert"
    r"|rechaz\w*|revert\w*|revirt\w*|fall(?:ó|o|a|aron|id[oa])|pendiente|bloqu\w*"
    r"|отклон\w*|отказ\w*|отмен\w*|неудач\w*|ожида\w*|заблокирован\w*"
    r"|رفض|فشل|معلق|محظور"
    r"|rejeit\w*|recus\w*|revert\w*|substitu\w*|falh\w*|pendente|bloqu\w*|aviso|segurança)\b"
    r"|\b(?:only after|only when|only if|not before|unless|provided that|prior approval|approval is required"
    r"|requires? (?:user |explicit )?approval|pending (?:user |explicit )?approval|awaiting approval"
    r"|requer(?:em|id[oa]s?)?|exige(?:m)?|requiere(?:n)?|requiert|erfordert|benötigt|требует(?:ся)?|нужно|يتطلب|必要|要する|需要"
    r"|somente após|só após|apenas depois|a menos que|desde que|aprovação prévia|requer aprovação|aguardando aprovação"
    r"|solo después|solo tras|a menos que|siempre que|aprobación previa|requiere aprobación"
    r"|seulement après|à moins que|à condition que|sous réserve|approbation préalable"
    r"|erst nach|erst wenn|es sei denn|sofern|vorherige (?:genehmigung|zustimmung)"
    r"|только после|только тогда|если не|при условии|предварительн\w+ (?:одобрен|согласован)"
    r"|فقط بعد|فقط عندما|إلا إذا|بشرط|موافقة مسبقة"
    r"|承認後|承認を得|の場合のみ|仅当|除非|经批准|前提是)(?:\b|(?=[^\x00-\x7F]))"
    r"|拒否|失敗|保留|禁止|拒绝|失败|待处理|してはいけない|ならない|許可|優先|依頼|質問"
    r"|不得|不要|必须|允许|安全|优先|请求|问题|[?？]"
    r"|\b(?:tool inventory|available tools|available capabilities|inventário de ferramentas|ferramentas disponíveis)\b"
)

# fixed values: openers of requests
OPENERS = (
    r"you should|you must|you need to|can you|could you|would you|do you"
    r"|do|run|search|find|identify|locate|determine|check|verify|analyze|compare|list|explain"
    r"|create|update|fix|add|remove|keep|use|execute"
    r"|faça|faca|execute|atualize|corrija|adicione|remova|mantenha|use"
    r"|haz|ejecuta|actualiza|corrige|añade|elimina|mantén|usa"
    r"|faites|exécutez|mettez|corrigez|ajoutez|supprimez|gardez|utilisez"
    r"|mach|führe|aktualisiere|korrigiere|füge|entferne|behalte|verwende"
    r"|сделай|выполни|обнови|исправь|добавь|удали|сохрани|используй"
    r"|افعل|نفذ|حدّث|أصلح|أضف|احذف|احتفظ|استخدم|実行|更新|修正|追加|削除|保持|使用|请|执行|更新|修复|添加|删除|保留|使用"
)

# fixed values: the anchor families; the order decides which span a match gets
ANCHOR_FAMILIES = (
    r"```[\s\S]*?```",
    r"->|→",
    r"(?:^|(?<=\n)|(?<=[.!?。！？]\s))[ \t]*(?:[-*][ \t]+)?(?:" + OPENERS + r")(?:\b|(?=[^\x00-\x7F]))",
    r"(?:^|(?<=[.!?。！？]\s))[^.!?。！？:：\n]{1,48}[:：]",
    r"`[^`\n]+`",
    r"https?://[^\s<>]+",
    r"\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b",
    r"(?<![A-Za-z0-9_.-])\.[A-Za-z_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_-])?(?=$|[\s,;:!?)}\]]|\.(?=\s|$)|[^\x00-\x7F])",
    r"(?<![A-Za-z0-9_.-])/?(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]*[A-Za-z0-9_-](?:::[A-Za-z0-9_.-]*[A-Za-z0-9_-])*(?=$|[\s,;:!?)}\]]|\.(?=\s|$)|[^\x00-\x7F])",
    r"\b\d+(?:[./,:-]\d+)*(?:[ \t]*(?:%|ms|sec|seconds?|bytes?|KB|MB|GB|TB|Hz|kHz|MHz|GHz|mm|cm|km|m|kg|g|USD|EUR|BRL))?\b",
    RISK,
    r"(?<![A-Za-z0-9_])(?-i:[A-Za-z_][A-Za-z0-9_]*_[A-Za-z0-9_]+|[a-z]+(?:[A-Z][A-Za-z0-9]*)+|[a-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)(?![A-Za-z0-9_])",
)
ANCHORS_RE = re.compile("|".join(ANCHOR_FAMILIES), re.I | re.M)
RISK_RE = re.compile(RISK, re.I | re.M)
TOKEN_RE = re.compile(TOKEN)

# fixed values: phrases without content
FILLERS = (
    "please make sure that", "please make sure", "please note that", "it is important to note that",
    "it should be noted that", "as a matter of fact", "in order to", "basically", "actually",
    "por favor certifique-se de que", "por favor certifique-se", "é importante observar que",
    "é importante notar que", "vale a pena lembrar que", "de modo geral", "basicamente",
)
FILLERS_RE = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(f) for f in sorted(FILLERS, key=len, reverse=True)) + r")(?!\w)", re.I)
UNIT_RE = re.compile(r".+?(?:[!?]+|\.(?=\s+(?:[A-ZÀ-Ý]|$)|$)|(?=\n|$))")
CLAUSE_RE = re.compile(r".+?(?:[!?;。！？；؟؛]+|[,،](?=\s)|\.(?=\s|$)|(?=\n|$))")
PAIR_TOKEN_RE = re.compile(r"`[^`\n]+`|https?://[^\s]+|(?:/[\w.@+%-]+)+|[\w]+(?:['’-][\w]+)*|[^\w\s]")
SENTENCE_STOPS = "!?。！？\n"

# fixed values: words of status, by kind, as the checkpoint reads them (Java and Python dialects agree on them)
STATUS = {
    "done": r"(?:done|completed|finished|implemented|added|removed|updated|created|fixed|resolved|reverted|ran|tested|validated|passed|failed|merged|wrote|patched"
    r"|conclu[íi]|feito|implementei|adicionei|removi|atualizei|criei|corrigi|resolvi|reverti|rodei|testei|validei|passei|falhou|mesclei|revisei)",
    "next": r"(?:next|pending|todo|to do|remaining|follow-?up|after that|once .+ (?:pass|green)|pr[óo]xim[oa]s?|pendente|a seguir|falta|em seguida|depois disso|por fazer)",
    "decision": r"(?:decision|decided|chose|choose|instead|rather than|reason|because|decidimos|decidi|escolhi|em vez de|porque|raz[ãa]o)",
    "fail": r"(?:fail(?:ed|ure)?|error|exception|fatal)",
    "constraint": r"(?:only|restrict(?:ed|ion|ing)?|read-?only|at (?:most|least)|no (?:more|fewer|less) than|cap(?:ped|s)?|limits?|limited|maximum|minimum|prohibit(?:ed)?|forbid(?:den)?|den(?:y|ied|ies)"
    r"|exclusiv\w+|somente|apenas|restrit\w+|no máximo|no mínimo|proibid\w+|obrigat[óo]ri\w+|exigid\w+)",
}
NARRATION = (
    r"(?:great question|happy to|take a look|have a look|i'll start|let me start|sure|of course|certainly|thanks|thank you|appreciate|no problem|ok|okay|continue"
    r"|unrelated|turned out|just to be safe|for completeness|double[- ]?checked|com certeza|claro|obrigad[oa]|valeu|sem problemas|tudo bem|pode continuar)"
)
LABEL = r"^[^.!?。！？:：\n]{1,48}[:：]$"
PASS_ROW = r"^(?:collected \d+ items|.*\bPASSED\b)$"

# fixed values: ceremony at the start of answers, filler at their end
CEREMONY = (
    "Sure", "OK", "Okay", "Alright", "Got it", "Let me", "I'll", "I will", "Here's", "Here is", "Great", "Thanks", "Thank you",
    "Absolutely", "Certainly", "Of course", "No problem", "Let's", "Shall we", "I'd be happy to", "I can help with that", "Claro", "Claro que sim",
    "Com certeza", "Sem problemas", "Por supuesto", "Desde luego", "Sin problema", "Bien sûr", "Pas de problème", "D'accord",
)
CEREMONY_RE = re.compile("(?:" + "|".join(CEREMONY) + ")[,.! ]+", re.I)
CLOSING = (
    "Let me know", "Hope this helps", "Feel free to ask", "If you need anything", "Happy to help", "Não hesite", "Dúvida", "Fique à vontade",
    "N'hésitez pas", "Besoin d'autre", "Zögern Sie nicht", "Lassen Sie mich wissen",
)
CLOSING_RE = re.compile("(?:" + "|".join(CLOSING) + ")", re.I)

BASE64_RE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{128,}={0,2}(?![A-Za-z0-9+/=_-])")
ERROR_VALUES = frozenset(("error", "fatal", "critical", "failed", "fail", "exception", "err", "timeout"))
HARD_LITERAL = r"`[^`\n]+`|\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b|\b(?:[\w.-]+/)+[\w.-]+\.[A-Za-z0-9]+\b"
ROLES = ("core", "action", "constraint", "evidence", "mechanism", "identifier", "detail", "noise")
ROLE_ALIASES = {"central_claim": "core", "supporting_evidence": "evidence", "required_reproduction": "mechanism", "context": "detail", "redundant": "noise"}
BUILDER_WORD = r"[\w@./:+%-]+"
BUILDER_ANCHOR = r"https?://\S+|`[^`]+`|\b\d+(?:[.,]\d+)*(?:%|[A-Za-z]+)?\b"
ENTITIES = {
    "block_id": r"blk_-?\d+",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "node": r"dfs\.\w+(?:\$\w+)?",
    "port": r":\d{4,5}\b",
    "timestamp": r"\d{6}\s+\d{6}",
    "url": r"https?://\S+",
    "path": r"(?:/[\w.-]+){2,}",
    "size": r"(?i)\b\d+(?:\.\d+)?(?:KB|MB|GB|bytes?)\b",
}
