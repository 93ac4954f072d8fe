"""Word classes and phrase rules for abusive, hateful and sexual language in five languages.

All entries are fixed values, written as folded words (lower case, no accents). A rule is a
sequence of words or classes (capitals); ``~n`` before an entry lets up to n other words
stand between, without it at most one. Alternatives are divided by ``|``.
"""

from __future__ import annotations

CLASSES = {
    "INSULT": (
        # English
        "idiot idiots imbecile moron morons cretin dumbass dimwit jackass asshole assholes scumbag bastard bastards loser dickhead jerk nitwit halfwit dumbo bitch prick wanker twat fuckwit clown lowlife coward scum "
        # Portuguese
        "idiota idiotas imbecil cretino cretina babaca otario otaria canalha palhaco palhaca burro burra animal verme desgracado desgracada trouxa retardado vagabundo vagabunda corno arrombado "
        # Spanish
        "cabron cabrona tarado tarada payaso payasa gilipollas pendejo pendeja estupida capullo imbeciles subnormal hijoputa mamon "
        # French
        "cretin cretine abruti abrutie connard connasse salaud salope crapule encule debile ordure batard pauvre "
        # German
        "trottel schwachkopf vollpfosten arschloch depp vollidiot idioten dummkopf mistkerl wichser drecksack versager penner"
    ),
    "BADADJ": (
        "stupid pathetic useless worthless brainless goddamn fucking disgusting miserable retarded incompetent "
        "patetico patetica inutil imprestavel nojento nojenta estupido burro ridiculo "
        "asqueroso asquerosa miserable despreciable ridiculo "
        "stupide pathetique inutile minable degoutant degoutante meprisable nul nulle "
        "dumm dummer dumme dummes nutzlos nutzloser nutzlose erbarmlich erbarmlicher erbarmliche widerlich widerlicher widerliche blod bloder erbarmliches widerliches nutzloses"
    ),
    "BODY": (
        "tits ass cock cocks thighs thigh breasts breast boobs pussy dick nipples butt hips cunt "
        "seios peitos quadris coxas bunda tetas bucetas buceta pau mamilos "
        "muslos pechos culo coño pezones caderas nalgas "
        "seins cuisses fesses nichons chatte hanches poitrine cul "
        "titten brusten bruste brust schenkeln schenkel arsch muschi schwanz huften hintern po"
    ),
    "EROTIC": (
        "nude naked horny wet hot topless aroused dirty sexy turned "
        "nua pelada molhada excitada tesuda nu pelado "
        "desnuda mojada caliente excitada cachonda desnudo "
        "nue mouillee excitee chaude nu coquine "
        "nackt nackte nackten feucht feuchte geil geile erregt"
    ),
    "MOAN": "moaning gasping groaning panting gemendo gemia gimiendo gemian gemissait gemissante gemissaient gemissant stohnend stohnte stohnen keuchend",
    "VERMIN": (
        "vermin rats cockroaches parasites scum subhuman subhumans filth pests pest plague animals swine pigs disease "
        "praga pragas ratos porcos lixo parasitas vermes baratas escoria peste nojentos "
        "plaga ratas cerdos basura parasitos cucarachas alimanas "
        "vermine rats porcs cafards parasites racaille ordures chiens "
        "ungeziefer ratten schweine abschaum parasiten gesindel pack kakerlaken"
    ),
    "LIMB": (
        "face fingers legs bones teeth neck skull jaw arms hands head nose ribs kneecaps "
        "cara dentes pernas dedos ossos pescoco dientes piernas huesos figure gueule jambes dents doigts os zahne nase knochen finger fresse beine"
    ),
}

# fixed values: words that mark a mention of such language rather than its use
MENTION = frozenset(
    "word words term terms lexicon glossary filter filters moderation moderator moderators flagged flag quoted quote quotes quotation classifier dictionary blocklist label labels slur slurs insult insults "
    "palavra palavras termo termos filtro moderacao insulto insultos citacao palabra palabras termino terminos moderacion cita "
    "mot mots terme termes filtre moderation insulte insultes citation wort worter begriff begriffe zitat beleidigung beleidigungen moderation".split()
)

ABUSIVE = """
shut the|your ~2 up
shut up
get lost ~4 INSULT|you
get lost
go ~1 to hell
burn in hell
piece of crap|shit|trash|garbage|dirt
nobody|noone ~1 wants|likes|needs|loves|misses you
disappear for ~1 good|ever
do everyone ~3 favour|favor ~2 disappear|leave|quit|die
smash|break|crush|punch|bash|snap|kick|rip ~1 your ~1 LIMB
ill|will|gonna ~3 kill|hurt|strangle|stab|shoot|murder|beat|hunt ~1 you
kill|hang yourself
drop dead ~3 you|INSULT
ashamed ~6 born
where you live ~5 break|kill|hurt|come|find|smash|burn
know ~1 where you live
rat|door|dog|stone|brick|donkey|monkey ~2 has|have|had ~2 brain|brains ~2 than you
than you ~1 INSULT
hope ~2 they|he|she ~2 fire|sack ~1 your|you ~3 ass|INSULT|BADADJ
fire your ~2 ass
you ~5 INSULT
you|youre ~1 are|re|re ~4 BADADJ
your BADADJ ~1 ass|face|head|brain
you BADADJ ~2 INSULT
what a ~3 INSULT
whoever ~3 wrote|did|made|committed|broke ~5 INSULT|BADADJ
screw|fuck you|off|yourself
INSULT ~1 you ~2 BADADJ|INSULT
cala|cale|calem ~1 a ~1 boca
vai|va|vao ~1 pro|para|ao|pra|se ~2 inferno|diabo|merda|foder|lascar
some|suma|desaparece|desapareca ~1 daqui
quebre|quebro|quebrar|parto|partir|arrebento|arrebentar|esmago ~1 a|os|as|seus|suas ~1 sua|tua|seus|suas|teus|tuas|LIMB ~1 LIMB
quebre|quebro|quebrar|arrebento|arrebentar ~3 sua|tua LIMB
ninguem ~1 te|voce suporta|aguenta|quer|gosta
porta|pedra|rato|burro ~1 pensa|raciocina ~1 melhor|mais ~1 que|do ~1 voce|tu
voce|voces ~1 e|sao|es ~3 INSULT|BADADJ
seu|sua|seus|suas INSULT ~4 BADADJ|merda
seu|sua|seus|suas ~1 INSULT
quem escreveu|fez|criou|programou ~5 INSULT|BADADJ
palhaco|payaso|clown de merda|mierda|merde
callate
vete|vaya|anda|idos ~1 al|a|la ~1 diablo|infierno|mierda
voy a partir|romper|reventar|destrozar ~2 LIMB
ojala ~1 te ~1 despidan|echen|mueras
eres|sos ~3 INSULT|BADADJ
quien escribio|hizo|programo ~5 INSULT|BADADJ
nadie ~1 te soporta|aguanta|quiere ~4 INSULT|aqui
nadie te soporta|aguanta
hasta ~1 una ~1 puerta|piedra|rata ~3 que tu
te ~1 odio ~2 INSULT
ferme|fermez ~1 la|ta|ton|gueule ~3 INSULT
ferme ta gueule
va|allez ~1 au|en diable|enfer
vais ~1 te casser|peter|briser|defoncer ~2 LIMB
personne ~1 ne ~1 te|vous ~1 supporte|aime|veut
tu|t es ~3 INSULT|BADADJ
celui qui ~1 a ecrit|fait|code ~5 INSULT|BADADJ
meme ~1 une ~1 porte|pierre|rat ~4 que toi
espece ~1 de|d INSULT
degage ~3 INSULT
j|on espere ~4 virer|virent ~3 INSULT
halt|haltet ~1 die|das|deine klappe|fresse|maul|schnauze
fahr|geh|scher ~1 zur|zum holle|teufel
schlag|schlage|brech|breche|hau|haue ~1 dir ~2 LIMB
keiner|niemand ~1 will|braucht|mag|ertragt|vermisst dich
du bist ~4 INSULT|BADADJ
du ~2 INSULT
wer ~1 das ~1 geschrieben|gemacht|verbrochen ~6 INSULT|BADADJ
hau ab ~3 INSULT
sogar|selbst ~1 eine ~1 tur|ratte ~4 als du
verpiss dich
"""

HATEFUL = """
breed|breeding|multiply|spread like VERMIN|rabbits|flies
they|those|these ~4 are ~1 all|nothing|just|like|no|VERMIN ~3 VERMIN
are ~2 vermin|subhuman|subhumans|cockroaches|parasites|swine
hate ~4 they ~1 are|breed|all ~3 VERMIN
hate migrants|foreigners|immigrants|refugees|jews|muslims|blacks|gays|women|arabs|gypsies
not|dont|t deserve ~1 to ~1 live|exist|breathe
should|must|ought ~1 be|to ~2 driven|thrown|kicked|wiped|chased ~1 out
should|must be deported|exterminated|gassed|wiped|eliminated|banned ~5 country
driven|thrown|kicked|chased out of ~1 this|our|the country
born thieves|criminals|liars|killers|rapists
never hire ~3 they ~2 born|are
are ~1 too stupid|dumb|lazy|primitive ~1 to
lock|round|throw ~1 up|out ~5 before they ~2 infect|ruin|destroy|poison|kill
before they infect ~1 us|everyone|all
fault of ~2 filthy|dirty|damn|stinking|lousy
filthy|stinking migrants|foreigners|immigrants|refugees|jews|muslims
world ~2 be ~2 better|cleaner|safer ~2 without
send|ship ~3 back ~3 where they ~1 came
nao|nem merecem ~2 viver|existir
sao ~2 praga|peste|vermes|parasitas|baratas|escoria
deviam|deveriam|devem|tem ~1 ser|de ~1 expulsos|deportados|banidos|exterminados|expulsas
expulsos|expulsas|deportados do|deste ~1 pais
nunca contrate|contratem ~5 nascem|sao ~2 ladroes|bandidos|criminosos
ja nascem ladroes|bandidos|criminosos
odeio|detesto ~1 os|as|esses|todos ~4 sao ~2 VERMIN
culpa ~1 e|dos|das|desses ~2 imundos|sujos|nojentos
mundo ~2 melhor sem ~1 os|as|esses
esses|essas|aqueles ~3 sao ~2 VERMIN
burros|estupidos demais ~1 para|pra
no merecen ~2 vivir|existir
son ~1 una plaga|peste
esos|esas|estos ~3 son ~2 VERMIN
echar|expulsar|deportar ~2 todos ~4 pais
odio|detesto ~1 a ~1 los|las|esos ~4 son ~2 VERMIN
culpa ~1 de|es ~2 sucios|asquerosos|malditos
mundo ~2 mejor sin ~1 los|las
nunca contrates|contraten ~5 ladrones|delincuentes
demasiado|tan estupidos|tontos ~1 para ~2 programar|codigo
ne|n meritent pas ~2 vivre|exister
sont ~3 vermine|cafards|parasites|racaille|peste|fleau
chasser|expulser|deporter ~1 tous ~5 pays
hais|deteste|deteste ~1 les|ces ~5 sont ~2 VERMIN
ces ~3 sont ~3 VERMIN
faute ~2 sales|maudits
monde ~3 meilleur|mieux sans ~1 les|ces
embauchez|engagez ~1 jamais ~5 voleurs
trop ~1 betes|stupides ~2 coder|ecrire|programmer
haben|hat kein|keine recht ~5 leben
verdienen ~1 es ~1 nicht ~4 leben
sind ~2 ungeziefer|abschaum|parasiten|gesindel|kakerlaken|untermenschen
diese|die|solche ~3 sind ~1 alle|nur|VERMIN ~2 VERMIN
hasse|verachte ~1 die|diese|alle ~4 sind ~1 alle|VERMIN ~1 VERMIN
hasse|verachte ~1 die|diese|alle ~4 sind VERMIN
gehoren|gehort ~3 aus ~1 dem|diesem|unserem land
land gejagt|geworfen|geschmissen
schuld ~3 dreckigen|schmutzigen|verdammten
welt ~3 besser ohne
niemals|nie ~2 einstellen ~4 diebe
geborene diebe|verbrecher|lugner
zu dumm|blod ~2 zum|um ~4 programmieren|schreiben|code
"""

SEXUAL = """
had|having sex ~1 on|with|in|at|again|all
have sex with ~1 me|you|her|him
send|show|text ~1 me ~1 EROTIC ~1 pics|photos|pictures|videos|nudes
pics|photos|pictures ~1 of your|her|his BODY
lick|suck|kiss|touch|squeeze|bite|fuck|caress|rub ~1 your|her|his|my ~1 BODY
get|am|so ~1 EROTIC ~1 when|thinking ~2 think|of ~3 BODY|you
think|thinking of|about ~1 your BODY
EROTIC and MOAN
MOAN in|on ~1 his|her|my|your bed
stripped|undressed ~1 her|him ~1 slowly
kissed|licked|sucked|squeezed|fondled ~1 her|his|my BODY
hands|hand|fingers slid|slipped|moved ~1 under|up|into|inside ~1 her|his skirt|dress|shirt|pants|blouse|panties
gasped|moaned|begged|screamed ~1 for more
let|want|wanna|going ~1 me|to|gonna ~1 undress|fuck|lick|strip you
come over tonight ~4 undress|naked|nude|strip
undress you
fuck|fucked|fucking ~1 me|her|him|you ~2 hard|all|on|tonight|harder
transaram|fuderam|foderam|treparam ~1 em|na|no|a|sobre|com
transar com|contigo
lamber|chupar|beijar|apertar|morder ~1 os|as|o|a|seus|suas ~1 seus|suas|teus|tuas|sua|seu|BODY ~1 BODY
lamber|chupar|beijar|apertar ~2 BODY
manda|envia|mande|envie|mostra ~1 foto|fotos|nudes ~2 EROTIC
foto|fotos EROTIC ~1 dos|das|do|da
EROTIC e MOAN
MOAN na|no ~1 cama
fico|estou|fiquei ~1 com tesao
tesao ~3 pensar|em
tuvieron|tuvimos|tener|tuve sexo ~1 sobre|en|con|contra
follaron|follar|coger|cogieron ~1 sobre|en|contigo|con
lamer|chupar|besar|tocar|apretar ~1 tus|sus|tu|su ~1 BODY
mandame|enviame|muestrame ~1 fotos|foto ~1 EROTIC
fotos|foto EROTIC ~1 de
EROTIC y MOAN
MOAN en ~1 su|mi|tu cama
pongo|pones|pone ~1 EROTIC|cachondo ~4 pienso|pensar
baise|baises|couche|niquent ~1 sur|dans|contre ~1 le|la|un|une
lecher|sucer|embrasser|caresser|toucher ~1 tes|ses|ton|ta ~1 BODY
envoie|envoyez|montre ~1 moi ~1 des|tes photos ~2 EROTIC
photos EROTIC ~1 de
EROTIC et MOAN
MOAN dans ~1 son|mon|ton lit
excite|excitee quand ~1 je pense ~3 BODY|toi
hatten|haben|hatte|hattest sex ~1 auf|mit|im|in|am
fickten|ficken|gefickt ~1 auf|mit|dich
deine|deinen|ihre|ihren|deiner ~1 BODY ~5 lecken|kussen|lutschen|streicheln|anfassen
lecken|kussen|lutschen ~3 deine|deinen BODY
schick|schicke|zeig|sende ~1 mir ~1 EROTIC ~1 fotos|bilder|foto|bild
fotos|bilder von|deiner ~1 deinen|deiner|deine|ihren BODY
EROTIC und MOAN
MOAN in ~1 seinem|ihrem|meinem|deinem bett
werde|bin|wird ~1 so|ganz|EROTIC ~2 wenn ~3 denke ~4 BODY|dich
"""
