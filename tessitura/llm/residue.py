"""Texts that hold what was served or left in place of content: templates, filler, error pages, script notices."""

from __future__ import annotations

import math
import re
import re._parser as sre
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.lookalike import _SPELLING

BITS = 18
#: Tokens of the windows in which a longer sentence is judged, all along it.
WINDOWS = (6, 12)
#: In the fit, every so many windows of an ordinary sentence are taken.
WINDOW_STEP = 3

# The weak labels, from public standards and conventions. They only train the classifier, which decides.
# Delimiters of public template languages.
PLACEHOLDERS = [
    r"\{\{.{0,60}?\}\}", r"\{(?:\d{1,2}|[^\W\d_]+(?:_[^\W\d_]+)*)\}", r"[$#]\{[^{}]{1,60}\}", r"%%[\w.-]+%%", r"%\(\w+\)[sdf]", r"\b__[^\W\d_]+(?:_[^\W\d_]+)*__",
    r"\$[^\W\d_a-zа-я][^\Wa-zа-я]*\$", r"\[\[[^\[\]]{1,60}\]\]", r"\[(?:INSERT|YOUR|ADD|ENTER)\b[^\[\]]{0,40}\]", r"\[[^\W\d_a-zа-я]{2,}(?:[ _][^\W\d_a-zа-я]+)*\]",
    r"<%.{1,60}?%>", r"\{%.{1,60}?%\}", r"<[^\W\d_a-zа-я][^<>a-zа-я=]{1,40}>", r"«[^\W\d_a-zа-я][^«»a-zà-ÿа-я]{1,40}»", r"@@[\w.-]+@@", r"\*\|[\w.-]+\|\*",
]
# Reason phrases of HTTP status codes.
REASONS = "Bad Request|Unauthorized|Payment Required|Forbidden|Not Found|Method Not Allowed|Not Acceptable|Proxy Authentication Required|Request Time-?out|Conflict|Gone|Length Required|Precondition Failed|Content Too Large|URI Too Long|Unsupported Media Type|Range Not Satisfiable|Expectation Failed|Unprocessable (?:Content|Entity)|Too Many Requests|Unavailable For Legal Reasons|Internal Server Error|Not Implemented|Bad Gateway|Service Unavailable|Gateway Time-?out|HTTP Version Not Supported"
# Status lines and what public servers and language runtimes put out; at the start of a sentence.
STATUS = [
    r"(?:https?(?:/[\d.]+)?|error|erreur|fehler|erro|ошибка|エラー)\W{0,2}(?:code |código |http )?[45]\d\d(?!\d)", rf"[45]\d\d\W+(?:{REASONS})", rf"(?:{REASONS})\W*$", r'\{\W*(?:status|error|message|code)\W', r"<(?:error|code|message)>", r"(?:type|http status)\W.*\bstatus\b",
    r"sqlstate", r"traceback \(most recent", r'file ".+", line \d', r"(?:\w+\.)*\w*(?:error|exception)(?::| in )", r"(?:fatal error|parse error|warning|notice): .* (?:in|on line) ", r"at \w+(?:\.\w+)+\(.*:\d+\)", r"failed to load resource", r"(?:request|connection|operation|gateway) timed? ?out",
    r"(?:request|reference|ray|incident|error) id\W{1,3}[0-9a-f#]{6}", r"description\W+the (?:origin )?server", r"(?:nginx|apache|openresty|cloudfront|varnish|[\w-]*(?:gateway|proxy|edge)[\w-]*)(?:/[\d.]+)?\W*$", r"return \w+\[",
]
# Messages in place of content, by language. Each stands for one sense: refusal, log-in, expiry, limits, failure, trying again, absence, outage.
MESSAGES = [
    r"access (?:is |was |has been |to \w+ \w+ )?(?:denied|forbidden|restricted|blocked)", r"permission (?:denied|required|to (?:view|access|see|open))", r"not (?:authori[sz]ed|allowed|permitted) to", r"(?:log|sign)(?:ged|ned)?[ -]?in (?:is )?(?:required|again|first|to)\b", r"please (?:log|sign)[ -]?in", r"must be (?:logged|signed) in",
    r"(?:logged|signed) out", r"(?:session|link|token|domain|certificate|subscription) (?:has |is )?expired", r"(?:visible|available|open|restricted) (?:only )?to (?:registered |paying )?(?:members|subscribers|users)", r"blocked by (?:our|the|your)", r"not available in your", r"rate[ -]limit", r"too many requests", r"^\W*slow down",
    r"checking your browser", r"verify (?:that )?you(?: are|'re) (?:a )?human", r"unusual (?:traffic|activity)", r"contact (?:your|the) (?:registrar|site owner|administrator|webmaster|support)", r"something went wrong", r"(?:unexpected|unknown|internal|technical) (?:error|problem)", r"error (?:has )?occurr?ed", r"(?:has|have) been notified", r"(?:try|check) (?:again|back)\b",
    r"^\W*(?:we'll be )?(?:right )?back (?:soon|shortly|later)", r"(?:temporarily|currently|is|are) (?:unavailable|offline|down)\b", r"(?:down|undergoing|scheduled|under|closed) (?:for )?(?:\w+ )?maintenance", r"error establishing", r"(?:could not|couldn't|cannot|can't|unable to|failed to|was not able to) (?:be )?(?:connect\w*|load\w*|complet\w*|reach\w*|display\w*|find|found|open\w*|process\w*|start\w*|show\w*|serv\w*|access\w*)",
    r"(?:page|file|link|resource|document|content|site|url|address|key|item)\b.{0,40}\b(?:not (?:be )?found|not exist|doesn't exist|no longer|moved|deleted|removed|broken)", r"you (?:were|are|requested|asked)\b.{0,12}\blook", r"may have been (?:moved|deleted|removed)", r"isn't available|is not available", r"did not find a current",
    r"acceso (?:denegado|restringido|prohibido)", r"no tienes? (?:los )?permisos?", r"inici[ae]r? sesión", r"sesión (?:ha )?(?:expirad|caducad)", r"(?:ha ocurrido|se ha producido|se produjo|ocurrió) un (?:error|problema)", r"int[ée]nt(?:alo|elo|ar)\b", r"no (?:está )?disponible", r"página\b.{0,25}\b(?:no |busca)", r"en mantenimiento", r"demasiadas (?:solicitudes|peticiones)",
    r"acesso (?:negado|restrito|proibido)", r"não tem (?:permissão|acesso|autorização)", r"(?:faça|efetue) (?:o )?login|inici[ae]r? (?:a )?sessão", r"sessão (?:expirou|expirada)", r"ocorreu um (?:erro|problema)|algo deu errado", r"tente (?:novamente|de novo|outra vez)", r"indisponível|não (?:está )?disponível", r"página\b.{0,25}\bnão|não encontrada", r"em manutenção",
    r"accès (?:refusé|interdit|restreint)", r"pas (?:autorisée?s? à|la permission|accès)", r"veuillez vous (?:re)?connecter", r"session a expiré", r"erreur (?:est survenue|s'est produite|inattendue)", r"réessa(?:yer|yez)", r"indisponible", r"page\b.{0,25}\b(?:introuvable|trouvée|n'existe)", r"en maintenance|maintenance en cours",
    r"zugriff (?:verweigert|nicht|wurde)", r"keine? (?:berechtigung|zugriff)|nicht berechtigt", r"melden sie sich|bitte anmelden|anmeldung erforderlich", r"sitzung (?:ist )?abgelaufen", r"fehler (?:ist )?(?:aufgetreten|passiert)|etwas ist schief", r"versuchen sie es|versuche es", r"nicht (?:verfügbar|erreichbar)", r"(?:seite|datei)\b.{0,25}\bnicht gefunden", r"wartung",
    r"доступ\b.{0,20}(?:запрещ|закрыт|ограничен)", r"(?:недостаточно|нет) прав", r"войдите|авторизуйтесь", r"(?:сессия|сеанс)\b.{0,20}ист[её]к", r"произошла (?:\w+ )?ошибка|что-то пошло не так", r"(?:повторите|попробуйте) (?:попытку|ещ|позже|снова)", r"недоступ", r"не найден", r"техническ\w+ работ",
    r"アクセス(?:が|を|は)?(?:拒否|制限|禁止|できません)", r"権限がありません", r"ログイン(?:して|が必要)", r"(?:セッション|有効期限).{0,8}切れ", r"(?:エラー|問題)が(?:発生|起き)", r"(?:もう一度|再度|しばらく|後で).{0,12}(?:お試し|試して)", r"(?:利用|表示|接続)(?:できません|いただけません)", r"見つかりません", r"メンテナンス中",
]
# Notices that scripts are required.
SCRIPT = r"(?:java ?script|\bjs\b|\bscripts?\b|\bscripting\b)"
SWITCH = r"(?:enabl|disabl|turned|switched|turn it|requir|need|must|allow|block|support|without|\boff\b|aktivier|benötig|einschalten|habilit|activ|desactiv|nécessit|necesit|precis|ativ|requier|включ|отключ|необходим|требует|有効|無効|必要)"
NOTICES = [rf"{SCRIPT}.{{0,40}}?{SWITCH}", rf"{SWITCH}.{{0,25}}?{SCRIPT}", r"^\W*(?:please )?(?:enable|turn|switch|disable|allow|schalten sie|active|actívalo|ative)\b.{0,30}\b(?:refresh|reload|browser|blocker|settings|navigateur|navegador|ein)\b"]
# What authors are told to write over.
FILLER = [
    r"^\W*(?:dummy|placeholder|sample|filler|example|test) (?:\w+ )?(?:text|copy|content|paragraph|intro|summary|description|caption|title|heading|headline|body|bio\w*|review|notes?|post|page|article|sentence)\b", r"(?:dummy|placeholder|filler) (?:text|copy|content)", r"^\W*this is (?:a |an |some |just )?(?:sample|dummy|placeholder|example|test)", r"(?:goes|belongs|comes) here\W*$",
    r"^\W*(?:add|enter|type|insert|write|put|paste|edit|replace|click)\b.{0,40}\b(?:here|below|box|field|your own|to (?:edit|change|add))\b", r"^\W*your [\w ]{3,25} here",
    r"texto de (?:relleno|ejemplo|muestra|prueba|exemplo|preenchimento)", r"aquí (?:va|irá|tu|su)\b|escrib\w+ aquí|insert\w+ aquí", r"(?:escreva|insira|digite|adicione)\b.{0,30}\baqui|aqui vai", r"faux texte|texte (?:factice|d'exemple|de remplissage)", r"(?:votre|insérez|saisissez|ajoutez|écrivez)\b.{0,30}\bici\b",
    r"blindtext|platzhalter|mustertext|beispieltext", r"hier (?:steht|kommt|folgt) (?:später|bald|ihr|dein|der|ein)|(?:ihr|dein) text\b", r"текст-?\s?(?:заполнитель|рыба|пример)|пример текста|(?:введите|вставьте|добавьте)\b.{0,30}\bздесь|здесь будет", r"ダミー|サンプル(?:テキスト|文)|(?:ここに|こちらに).{0,20}(?:入力|入り|記入|書)",
]
# Words of the customary filler Latin.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum pellentesque curabitur pretium tincidunt lacus gravida orci a odio nullam varius turpis commodo pharetra eros bibendum nec luctus felis sollicitudin mauris integer donec aenean vivamus praesent phasellus suspendisse morbi fusce etiam cras proin quisque sapien ligula risus metus vitae tellus mattis viverra massa ultrices ornare rutrum semper tortor egestas"
# Customary words without a meaning.
META = "foo bar baz qux quux blah bla test xxx abc"
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю")
# Verbs and nouns that name a thing, which then is not the thing itself.
NAMING = r"\b(?:call(?:ed|s)|named?|names|titled?|entitled|words?|phrases?|saying|says?|said|reads?|sings|sung|lyrics?|llamad[oa]|titulad[oa]|titula|llama|dice|palabras?|chamad[oa]|intitulad[oa]|diz|intitulée?|appelée?|s'appelle|nommée?|mots?|titres?|heißt|heisst|namens|genannt|titel|wort|wörter|называется|называют|слова|назван\w*|という|と呼ばれ)\b"
# Subjects of someone else's doing at the start of a sentence.
OTHERS = r"^\W*(?:she|he|they|her|his|their|its|i|my|mine|ella|él|ellos|su|sus|ela|ele|eles|elle|il|ils|elles|leur|leurs|son|sa|ses|er|ihre?|sein\w*|она|он|они|его|её|их|彼|彼女)\b"
# Tags of markup; other words in angle brackets are no tags.
TAGS = "html head body title h1 h2 h3 h4 h5 h6 hr br p div span a ul ol li em strong b i noscript center pre table tr td th section main header footer nav"
# Examples of such messages, positive cases of the fit beside the labelled sentences of the corpus.
EXAMPLES = [
    "Bad request.", "Unauthorized", "403 Forbidden", "404 Not Found", "The requested URL was not found on this server.", "Internal Server Error", "The server encountered an internal error and was unable to complete your request.", "502 Bad Gateway", "503 Service Unavailable", "The service is currently unavailable.", "504 Gateway Timeout",
    "Page not found", "The page you are looking for could not be found.", "This page does not exist or has been removed.", "Sorry, this content is no longer available.", "Oops, something went wrong.", "An error has occurred.", "An unexpected error occurred, please try again later.", "We are currently down for scheduled maintenance, please check back shortly.", "The site is offline, we will be back soon.",
    "Access denied.", "You do not have permission to access this resource.", "You are not authorized to view this page.", "Please log in to continue.", "You must be logged in to see this content.", "Sign in to your account to continue.", "Your session has expired, please log in again.", "Too many requests, slow down.", "Rate limit exceeded, try again in 60 seconds.", "Your IP address has been blocked.",
    "Please verify you are human to proceed.", "Checking your browser before accessing the site.", "We have detected unusual traffic from your network.", "Complete the captcha to continue.", "This video is not available in your country.", "This link has expired.", "Connection timed out.", "Connection refused.", "Unable to connect to the database.", "Failed to fetch data from the server.", "NullPointerException: null",
    "Please enable JavaScript to view this page.", "JavaScript is disabled in your browser.", "This site requires JavaScript and cookies to work.", "Your browser does not support scripts.", "You need to enable JavaScript to run this app.", "Turn on scripts and reload the page.", "Please disable your ad blocker.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Curabitur pretium tincidunt lacus, nulla gravida orci a odio.", "Sample text.", "Placeholder text goes here.", "Insert your text here.", "Enter a description here.", "Add your content here.", "Type your message in this field.", "Your title here", "This is a placeholder paragraph, replace it before publishing.", "asdf asdf asdf", "qwerty uiop asdf", "test test test",
    "Acceso denegado.", "No tienes permiso para ver esta página.", "Inicia sesión para continuar.", "Ha ocurrido un error, inténtalo de nuevo más tarde.", "Página no encontrada.", "La página que buscas no existe.", "Servicio no disponible.", "Sitio en mantenimiento.", "Activa JavaScript para ver esta página.", "Texto de ejemplo.", "Escribe aquí tu texto.",
    "Acesso negado.", "Você não tem permissão para acessar esta página.", "Faça login para continuar.", "Ocorreu um erro, tente novamente mais tarde.", "Página não encontrada.", "Serviço indisponível.", "Site em manutenção.", "Ative o JavaScript para ver esta página.", "Texto de exemplo.", "Escreva aqui o seu texto.",
    "Accès refusé.", "Vous n'êtes pas autorisé à accéder à cette page.", "Veuillez vous connecter pour continuer.", "Une erreur est survenue, veuillez réessayer plus tard.", "Page introuvable.", "La page demandée n'existe pas.", "Service momentanément indisponible.", "Site en maintenance.", "Veuillez activer JavaScript pour afficher cette page.", "Texte d'exemple.", "Saisissez votre texte ici.",
    "Zugriff verweigert.", "Sie haben keine Berechtigung, diese Seite aufzurufen.", "Bitte melden Sie sich an, um fortzufahren.", "Ein Fehler ist aufgetreten, bitte versuchen Sie es später erneut.", "Seite nicht gefunden.", "Die angeforderte Seite existiert nicht.", "Der Dienst ist derzeit nicht verfügbar.", "Wegen Wartungsarbeiten nicht erreichbar.", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "Dies ist ein Blindtext.", "Hier steht Ihr Text.",
    "Доступ запрещён.", "У вас нет прав для просмотра этой страницы.", "Войдите, чтобы продолжить.", "Произошла ошибка, попробуйте позже.", "Страница не найдена.", "Запрошенная страница не существует.", "Сервис временно недоступен.", "Ведутся технические работы.", "Включите JavaScript, чтобы открыть эту страницу.", "Пример текста.", "Введите текст здесь.",
    "アクセスが拒否されました。", "このページを表示する権限がありません。", "続けるにはログインしてください。", "エラーが発生しました。", "しばらくしてからもう一度お試しください。", "ページが見つかりません。", "現在サービスを利用できません。", "ただいまメンテナンス中です。", "JavaScriptを有効にしてください。", "これはダミーテキストです。", "ここに本文を入力してください。",
]

_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS))
# Ordinary sentences with the words of such messages, negative cases of the fit beside those of the corpus.
ORDINARY = [
    "The page was torn out of the notebook years ago.", "He turned the page and kept singing.", "An error in the score became the best part of the song.", "The servers at the cafe knew the whole album.", "Access to the roof was part of the fun.", "She asked for permission and got it a week later.", "The session musicians were paid on Fridays.", "Our session lasted until four in the morning.",
    "The service at the church was filmed for the video.", "They run a small service for touring bands.", "The band tried again in the autumn.", "We tried it again with a slower tempo.", "He will be back soon with a longer record.", "The team behind the label is small.", "Our team went to see them twice.", "The title of the record comes from a poem.", "A title track this long is rare.", "Most of the text was written on a train.", "The text on the sleeve is hard to read.",
    "She sampled a bell and a door.", "A test pressing was sold at the fair.", "The test of a good chorus is silence after it.", "The script for the video was two pages long.", "Scripts and costumes came from the theatre next door.", "The browser of old records found a rare one.", "The request came from the front row.", "Requests were played until midnight.", "The link between the two songs is a drum roll.", "They could not stop laughing between takes.", "I couldn't find a weak song on it.", "We could not be happier with the second half.",
    "The content of the box was a surprise.", "Nothing is missing and nothing was found later.", "The lost tapes were found in a garage.", "The connection between the singers is easy to hear.", "The museum was closed for two years.", "Too many guitars spoil the bridge.", "The limit of the tape was forty minutes.", "Please play it at my wedding, she wrote.", "The sign above the stage was broken.", "The log of the tour fills three books.", "Your favourite song may be the quiet one.", "Enter the bass, and the room changes.", "Replace the drummer and it is another band.",
    "La página del programa tenía una foto.", "El error de la cinta suena a propósito.", "La sesión duró toda la tarde.", "El servicio de la sala fue amable.", "No encontraron un final mejor.", "El texto habla de una casa vacía.", "A página do encarte tem uma foto.", "O erro na gravação virou refrão.", "A sessão foi gravada em um dia.", "O texto fala de uma casa vazia.", "La page du livret porte une photo.", "L'erreur du batteur est restée.", "La session a duré toute la nuit.", "Le texte parle d'une maison vide.", "Die Seite im Heft zeigt ein Foto.", "Der Fehler am Ende blieb auf dem Band.", "Die Sitzung im Studio dauerte lange.", "Der Text erzählt von einem leeren Haus.",
    "На странице буклета есть фотография.", "Ошибка барабанщика осталась в записи.", "Сессия длилась всю ночь.", "Текст рассказывает о пустом доме.", "歌詞のページには写真がある。", "間違いもそのまま残された。", "セッションは夜まで続いた。", "テキストは空き家の話だ。",
]

_DELIMITERS = re.compile(r"[{}\[\]<>%$@«|]|__")
_STATUS = re.compile(rf"^\W*(?:{'|'.join(STATUS)})", re.I)
_FILLER = re.compile("|".join(f"(?:{x})" for x in FILLER), re.I)
_NAMING, _OTHERS = re.compile(NAMING, re.I), re.compile(OTHERS, re.I)
_TICKED, _QUOTED = re.compile(r"`[^`]*`"), re.compile(r"[\"“”„«‘][^\"“”«»]{3,80}[\"”“»’]|「[^」]*」|『[^』]*』")
_LATIN, _META = frozenset(LATIN.split()), frozenset(META.split())
_MARKUP = re.compile(rf"</?(?:{'|'.join(TAGS.split())})\b[^<>]*>", re.I)
_LINES = re.compile("[\r\n\u2028\u2029\x85]+")
_ENDS = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
#: Words, numbers, letters of scripts without blanks one by one, and marks.
_TOKENS = re.compile("[぀-ヿ㐀-鿿]|[^\\W\\d_぀-ヿ㐀-鿿]+|\\d+|[^\\w\\s]|_")
_LETTERS = re.compile(r"[^\W\d_]+")
_CAPITAL = re.compile(r"[^\W\d_a-zа-яё]")
def needles(parsed) -> set[str] | None:
    """Strings of which every match of a parsed pattern holds one, as long as can be; None if there are none."""
    found: list[set[str]] = []
    run = ""
    for kind, what in [*parsed, (None, None)]:
        if kind is sre.LITERAL:
            run += chr(what)
            continue
        if run:
            found.append({run.lower()})
            run = ""
        inner = None
        if kind is sre.SUBPATTERN:
            inner = needles(what[3])
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and what[0] > 0:
            inner = needles(what[2])
        elif kind is sre.BRANCH:
            each = [needles(x) for x in what[1]]
            inner = None if None in each else set().union(*each)
        if inner:
            found.append(inner)
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


class _Phrases:
    """The patterns of messages, notices and filler. A sentence is only matched against those of which it holds a needle."""

    def __init__(self, patterns: Sequence[str]) -> None:
        self.patterns = [re.compile(x, re.I) for x in patterns]
        self.always, of = [], {}
        for i, x in enumerate(patterns):
            held = needles(sre.parse(x, re.I))
            if held is None:
                self.always.append(i)
            for needle in held or ():
                of.setdefault(needle, set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for needle, which in of.items():
            self.automaton.add_word(needle, which)
        self.automaton.make_automaton()

    def search(self, sentence: str) -> re.Match | None:
        """The first match, of equals the longest."""
        which = set(self.always).union(*(w for _, w in self.automaton.iter(sentence.lower())))
        hits = (self.patterns[i].search(sentence) for i in which)
        return min((h for h in hits if h), key=lambda h: (h.start(), -h.end()), default=None)


_MESSAGE = _Phrases([*MESSAGES, *NOTICES, *FILLER])


def sentences(text: str) -> list[str]:
    """Of a text without markup, odd blanks and invisible characters; lines end sentences."""
    found = []
    for line in _LINES.split(text):
        if not (line.isascii() and line.isprintable()):
            line = line.translate(_SPELLING)
        if "<" in line:
            line = _MARKUP.sub(" ", line)
        found += [s for part in _ENDS.split(line) if (s := part.strip())]
    return found


@lru_cache(maxsize=100_000)
def _keyboard(word: str) -> bool:
    """Whether all neighbours in the word lie at most two keys apart on one row, or are the same."""
    rows = [r for r in KEY_ROWS if set(word) <= set(r)]
    return len(word) >= 3 and bool(rows) and all(abs(rows[0].index(a) - rows[0].index(b)) <= 2 for a, b in zip(word, word[1:]))


def weak_label(sentence: str) -> int:
    """1: residue by placeholder, response status or phrase; -1: tells of such things; 0: neither; 2: unclear, not for the fit.

    A phrase labels its sentence if few words stand before it. It is told of, and no residue, where it is quoted, where
    a naming word or someone else's doing comes before it, or where it is a title in the middle of a sentence.
    """
    lower = sentence.lower()
    words = _LETTERS.findall(lower)
    if len(words) >= 3:
        if sum(w in _LATIN for w in words) >= 0.8 * len(words) or len(set(words)) == 1:
            return 1
        noise = "".join("x" if w in _META or _keyboard(w) else "." for w in words)
        if "xxx" in noise or noise.count("x") >= 0.6 * len(words) and len(set(words)) > 2:
            return 1
    if _DELIMITERS.search(sentence) and _PLACEHOLDER.search(sentence):
        return 1 if _PLACEHOLDER.search(_TICKED.sub(" ", sentence)) else -1
    if _STATUS.search(sentence):
        return 1
    hit = _MESSAGE.search(sentence)
    if hit is None:
        return 0
    for told in (*_TICKED.finditer(sentence), *_QUOTED.finditer(sentence)):
        if told.start() <= hit.start() < told.end() and hit.start() > 1:
            return -1
    before = sentence[: hit.start()].strip()
    if _NAMING.search(before) or _OTHERS.search(sentence):
        return -1
    named = _LETTERS.findall(hit.group())
    title = len(named) > 1 and all(_CAPITAL.match(w) for w in named if len(w) > 3)
    if title and before and before[-1] not in ".:;!?|" and not _CAPITAL.match(before.split()[-1]):
        return -1
    ahead = len(_TOKENS.findall(before)) // (2 if _WIDE.search(before) else 1)
    if ahead > 3 and _FILLER.search(hit.group()):
        return -1
    return 1 if ahead <= 7 and len(words) <= 24 else 2


_WIDE = re.compile("[぀-ヿ㐀-鿿]")
START, END = "\x02", "\x03"
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


class _Vocabulary(dict):
    """Number of each token seen; word and form of the tokens by number. A number, a name within a sentence and a word in capitals have a form in common."""

    def __init__(self) -> None:
        self.inner: list[int] = []
        self.first: list[int] = []
        self.form: list[int] = []
        self.kind: list[int] = []  # 1: word, 2: starts a window wherever it stands, 4: a quote

    def __missing__(self, token: str) -> int:
        if token.isdigit():
            word = inner = "0" if len(token) != 3 else token[0] + "00"
            form, kind = "0", 0
        elif token.isalpha():
            word, wide = token.lower(), bool(_WIDE.match(token))
            inner = word if token[0].islower() or token.isupper() or wide else "N"
            form = "w" if wide else "a" if token[0].islower() else "C" if token.isupper() and len(token) > 1 else "N"
            kind = 1 | (2 if form != "a" else 0)
        else:
            word = inner = form = token
            kind = 6 if token in '`"' else 2
        for into, value in ((self.inner, inner), (self.first, word), (self.form, "/" + form)):
            into.append(crc32(value.encode("utf-8", "surrogatepass")) + 1)
        self.kind.append(kind)
        self[token] = found = len(self.kind) - 1
        return found


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """Buckets of n-grams of numbers."""
    total = parts[0] * _ODD[0]
    for part, odd in zip(parts[1:], _ODD[1:]):
        total = (total ^ (total >> np.uint64(29))) * _ODD[1] + part * odd
    total ^= total >> np.uint64(32)
    return ((total * _ODD[2]) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Tokens:
    """Sentences as numbers: start and end marks stand around each. grams: by how many tokens they reach on, buckets of the
    n-grams that begin at each token (-1: none within its sentence)."""

    begin: np.ndarray
    end: np.ndarray
    grams: list[list[np.ndarray]]
    opens: np.ndarray

    def hashes(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """A 64-bit hash of what stands in each stretch."""
        size = to - at
        of = np.repeat(np.arange(len(at)), size)
        i = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = (i - at[of]).astype(np.uint64) + np.uint64(1)
        part = (self.grams[0][0][i].astype(np.uint64) + np.uint64(1)) * _ODD[0] ^ (self.grams[1][1][i].astype(np.uint64) + np.uint64(7)) * _ODD[3]
        part = (part ^ (part >> np.uint64(31))) * (place * _ODD[1] | np.uint64(1))
        sums = np.cumsum(np.append(np.uint64(0), part ^ (part >> np.uint64(29))), dtype=np.uint64)
        ends = np.cumsum(size)
        return (sums[ends] - sums[ends - size]).astype(np.int64)


def tokens(parts: Sequence[str], known: _Vocabulary) -> Tokens:
    listed = [[START, *_TOKENS.findall(s), END] for s in parts]
    size = np.array([len(x) for x in listed], np.int64)
    at = np.fromiter(map(known.__getitem__, (t for x in listed for t in x)), np.int64, int(size.sum()))
    end = np.cumsum(size)
    begin = end - size
    inner, first, form, kind = (np.array(x, np.uint64)[at] for x in (known.inner, known.first, known.form, known.kind))
    kind = kind.astype(np.int64)
    of = np.repeat(np.arange(len(size)), size)
    # the first word of a sentence is taken as it is
    is_word = np.flatnonzero(kind & 1)
    lead = is_word[np.append(True, of[is_word][1:] != of[is_word][:-1])] if len(is_word) else is_word
    word = inner
    word[lead] = first[lead]
    opens = (kind & 2) > 0
    opens[1:] |= (kind[:-1] & 3) == 2
    if len(at):
        quotes = np.cumsum((kind & 4) > 0)
        before = np.append(0, quotes)[begin]
        opens &= (quotes - before[of]) % 2 == 0  # nothing begins within quotes
        opens[begin] = True
        opens[end - 1] = False
        # a sentence's own first token is opened by its start mark
        opens[np.minimum(begin + 1, end - 1)] = False

    def grams(values: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(values), -1, np.int64)
        if len(values) >= n:
            whole = of[: len(values) - n + 1] == of[n - 1 :]
            out[: len(values) - n + 1] = np.where(whole, _mixed(*(values[i : len(values) - n + 1 + i] for i in range(n))), -1)
        return out

    return Tokens(begin, end, [[grams(word, 1)], [grams(word, 2), grams(form, 2)], [grams(word, 3), grams(form, 3)], [grams(form, 4)]], opens)


def _bucket(x: int) -> int:
    return min(int(math.log2(x + 1)), 9)


def _named(feature: str) -> int:
    return crc32(feature.encode()) >> (32 - BITS)


def places(docs: list[list[str]]) -> list[tuple[int, int, int, int]]:
    """For each sentence of each document: features of the document's length, of being the first, of being a title and of being most of the text."""
    out = []
    for parts in docs:
        whole, n = max(sum(map(len, parts)), 1), min(_bucket(len(parts)), 3)
        for i, s in enumerate(parts):
            title = s[0] == "#" or (i == 0 and len(parts) > 1 and s[-1] not in ".!?…。！？,;:")
            out.append((n, i == 0, title, 2 * len(s) > whole))
    return out


_PLACE = {x: [_named(f"p{x[0]}"), _named(f"f{x[1]}"), _named(f"h{x[2]}"), _named(f"r{x[3]}")] for x in ((n, f, h, r) for n in range(4) for f in (False, True) for h in (False, True) for r in (False, True))}
_SIZE = [_named(f"n{i}") for i in range(10)]
_WINDOW = _named("window")


def stretches(made: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is judged, as (first token, token after, sentence): first all sentences, then the windows along sentences that
    are longer. Windows start where something may begin: at the start, a capital, a number's or mark's edge, and at every
    letter of scripts without blanks; so they cover a sentence of any length."""
    of = np.repeat(np.arange(len(made.begin)), made.end - made.begin)
    at, to, sentence = [made.begin], [made.end], [np.arange(len(made.begin))]
    starts = np.flatnonzero(made.opens)
    last = made.end[of[starts]]
    for n in WINDOWS:
        begins = starts == made.begin[of[starts]]
        reach = starts + n + begins
        inside = (reach < last - 1) | (~begins & (reach - n + 2 < last) & (reach >= last - 1))
        at.append(starts[inside])
        to.append(np.minimum(reach, last)[inside])
        sentence.append(of[starts[inside]])
    return np.concatenate(at), np.concatenate(to), np.concatenate(sentence)


def _features(made: Tokens, at: np.ndarray, to: np.ndarray, more: list[list[int]]) -> list[np.ndarray]:
    """Buckets of all features of each stretch."""
    out, flat = [], [(reach, g.astype(np.int32)) for reach, group in enumerate(made.grams) for g in group]
    more = [np.array(x, np.int32) for x in more]
    for a, b, extra in zip(at.tolist(), to.tolist(), more):
        found = np.concatenate([*(g[a : max(b - reach, a)] for reach, g in flat), extra])
        out.append(found[found >= 0])
    return out


def _extras(of: np.ndarray, at: np.ndarray, to: np.ndarray, whole: int, place: list[tuple]) -> list[list[int]]:
    sizes = np.minimum(np.log2(to - at + 1).astype(np.int64), 9).tolist()
    return [[*_PLACE[place[s]][: 4 if i < whole else 2], _SIZE[n], *([] if i < whole else [_WINDOW])] for i, (s, n) in enumerate(zip(of.tolist(), sizes))]


@dataclass
class ResidueModel:
    """A linear classifier of sentences. validation: on sentences of hosts that took no part in the fit."""

    weights: np.ndarray
    bias: float
    validation: dict[str, float]

    def scores(self, texts: Sequence[str | None], known: _Vocabulary | None = None) -> np.ndarray:
        """Of each text the log-odds of its most suspicious sentence or window; minus infinity where there is none.

        The weights of n-grams are added up along all sentences at once; a stretch is the difference of two sums.
        """
        docs = [sentences(x) if x else [] for x in texts]
        parts = [s for d in docs for s in d]
        best = np.full(len(docs), -math.inf)
        if not parts:
            return best
        distinct = {s: i for i, s in enumerate(dict.fromkeys(parts))}
        made = tokens(list(distinct), known if known is not None else _Vocabulary())
        at, to, of = stretches(made)
        total = np.zeros(len(at))
        padded = np.append(self.weights.astype(np.float64), 0.0)  # bucket -1: no n-gram
        for reach, group in enumerate(made.grams):
            sums = np.append(0.0, np.cumsum(sum(padded[g] for g in group)))
            total += sums[np.maximum(to - reach, at)] - sums[at]
        n = len(made.begin)
        total += padded[_SIZE][np.minimum(np.log2(to - at + 1).astype(np.int64), 9)]
        window = np.full(n, -math.inf)
        np.maximum.at(window, of[n:], total[n:] + padded[_WINDOW])
        which = np.array([distinct[s] for s in parts])
        place = {x: (sum(padded[y]), sum(padded[y[:2]])) for x, y in _PLACE.items()}
        found = np.array([place[x] for x in places(docs)])
        score = self.bias + np.maximum(total[which] + found[:, 0], window[which] + found[:, 1])
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        np.maximum.at(best, doc, score)
        return best


def _fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, *, penalty: float, rounds: int, batch: int = 4_096) -> tuple[np.ndarray, float]:
    """L2-regularized logistic regression by AdaGrad, in a fixed order."""
    order = np.random.default_rng(7).permutation(len(rows))
    sizes = np.array([len(rows[i]) for i in order], np.int64)
    flat = np.concatenate([rows[i] for i in order]).astype(np.int32)
    labels, weights, ends = labels[order], weights[order], np.append(0, np.cumsum(sizes))
    w, bias, seen, seen_bias = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-6), 1e-6
    for _ in range(rounds):
        for begin in range(0, len(order), batch):
            upto = min(begin + batch, len(order))
            ids, n = flat[ends[begin] : ends[upto]], sizes[begin:upto]
            odds = bias + np.add.reduceat(w[ids], ends[begin:upto] - ends[begin])
            slope = weights[begin:upto] * (1 / (1 + np.exp(-np.clip(odds, -60, 60))) - labels[begin:upto])
            total = weights[begin:upto].sum()
            grad = np.bincount(ids, np.repeat(slope, n), 1 << BITS) / total + penalty * w
            seen += grad * grad
            w -= 0.3 * grad / np.sqrt(seen)
            g = slope.sum() / total
            seen_bias += g * g
            bias -= 0.3 * g / math.sqrt(seen_bias)
    return w.astype(np.float32), bias


def _cases(docs: list[list[str]], folds: list[int]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Labelled stretches of documents: rows of hash, fold and label, their features, and how often they are there. Windows of a sentence that tells of residue
    tell as well; of an ordinary one every third is taken; of residue those that are residue by themselves."""
    parts = [s for d in docs for s in d]
    kinds = {s: weak_label(s) for s in dict.fromkeys(parts)}
    place, fold = places(docs), [f for d, f in zip(docs, folds) for _ in d]
    made = tokens(parts, _Vocabulary())
    at, to, of = stretches(made)
    whole = len(parts)
    listed = None
    label = np.array([kinds[s] for s in parts], np.int64)[of]
    keep = label != 2
    windows = np.arange(whole, len(at))
    keep[windows[(label[windows] == 0) & ((at[windows] - made.begin[of[windows]]) % WINDOW_STEP > 0)]] = False
    for i in windows[label[windows] == 1].tolist():
        listed = listed if listed is not None else {}
        s = int(of[i])
        words = listed.get(s)
        if words is None:
            words = listed[s] = list(_TOKENS.finditer(parts[s]))
        a, b = at[i] - made.begin[s] - 1, to[i] - made.begin[s] - 1
        inside = words[max(a, 0) : min(b, len(words))]
        keep[i] = bool(inside) and weak_label(parts[s][inside[0].start() : inside[-1].end()]) == 1
    chosen = np.flatnonzero(keep)
    at, to, of = at[chosen], to[chosen], of[chosen]
    extra = _extras(of, at, to, int(np.searchsorted(chosen, whole)), place)
    # stretches that are the same, in like places, of one fold and label, are one case
    hashes = made.hashes(at, to) ^ np.array([hash(tuple(x)) for x in extra], np.int64)  # hashes of numbers are the same everywhere
    keys = np.column_stack([hashes, np.array(fold)[of] if len(of) else of, label[chosen]]).astype(np.int64)
    unique, first, times = np.unique(keys, axis=0, return_index=True, return_counts=True)
    features = _features(made, at[first], to[first], [extra[i] for i in first.tolist()])
    return unique, features, times


def _stretches_of(listed: list[str], windows: bool) -> list[np.ndarray]:
    """Features of the given sentences, each as a text of its own, and on request of the windows along them."""
    made = tokens(listed, _Vocabulary())
    at, to, of = stretches(made)
    n = len(at) if windows else len(listed)
    return _features(made, at[:n], to[:n], _extras(of[:n], at[:n], to[:n], len(listed), places([[s] for s in listed])))


def train_residue_model(docs: DataFrame, ident: str, text: str, host: str, *, most_documents: int = 40_000, most_cases: int = 100_000, penalty: float = 1e-7, rounds: int = 30) -> ResidueModel:
    """Fit on weak labels of a bounded sample, on EXAMPLES and on ORDINARY; validate on hosts that were left out.

    The sample: about most_documents documents, by a hash of their id, and of their different sentences and windows
    most_cases at most, those with a label first, then the most frequent; those in like places that differ in numbers
    and names only are one, which weighs the square root of its frequency. These bounds are parameters; only fitting uses
    them. One host of five (by hash; no host is a host of its own) is held out: precision, recall and F1 against the weak
    labels are measured there. An empty or unlabelled table gives a model that finds nothing.
    """
    count = docs.count()
    share = F.lit(min(1.0, most_documents / max(count, 1)))
    sample = docs.where(F.col(text).isNotNull()).where(F.pmod(F.xxhash64(F.col(ident), F.lit(8)), F.lit(1_000_003)) < share * 1_000_003).select(F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(F.coalesce(F.col(host), F.lit(""))), F.lit(5)).alias("fold"))

    # few files hold the sample, if the corpus is small: its labelling is spread over all cores
    sample = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds = batch["text"].to_pylist(), batch["fold"].to_pylist()
            for begin in range(0, len(texts), 500):
                keys, found, times = _cases([sentences(x) for x in texts[begin : begin + 500]], folds[begin : begin + 500])
                if found:
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, keys.T), lists, pa.array(times.astype(np.int64))], ["form", "fold", "label", "features", "times"])

    labelled = sample.mapInArrow(label, "form long, fold long, label long, features array<int>, times long")
    alike = labelled.groupBy("form", (F.col("fold") == 0).alias("held"), "label").agg(F.any_value("features").alias("features"), F.sum("times").alias("times"))
    rows = alike.orderBy((F.col("label") == 0).cast("int"), F.desc("times"), "form", "held").limit(most_cases).toArrow()
    cases = [np.array(x, np.int64) for x in rows["features"].to_pylist()]
    kind, times, held = rows["label"].to_numpy(), rows["times"].to_numpy().astype(float), rows["held"].to_numpy(zero_copy_only=False) if len(cases) else np.zeros(0, bool)
    labels = (kind == 1).astype(float)
    if not labels[~held].any():
        return ResidueModel(np.zeros(1 << BITS, np.float32), -1.0, {"cases": float(len(cases))})
    examples = [*_stretches_of(EXAMPLES, windows=False), *_stretches_of(ORDINARY, windows=True)]
    wanted = np.repeat([1.0, 0.0], [len(EXAMPLES), len(examples) - len(EXAMPLES)])
    train = np.flatnonzero(~held)
    weights = np.concatenate([(np.sqrt(times) * np.where(kind == -1, 2, 1))[train], np.where(wanted > 0, 8.0, 3.0)])
    w, bias = _fit([*(cases[i] for i in train), *examples], np.concatenate([labels[train], wanted]), weights, penalty=penalty, rounds=rounds)
    score = np.array([bias + float(w[c].sum()) for c in cases])
    hit = held & (score >= 0)
    right = (times * hit * labels).sum()
    precision, recall = float(right / max((times * hit).sum(), 1)), float(right / max((times * held * labels).sum(), 1))
    return ResidueModel(w, bias, {"cases": float(len(cases)), "held_out": float(held.sum()), "precision": precision, "recall": recall, "f1": 2 * precision * recall / max(precision + recall, 1e-9)})


def find_residue(docs: DataFrame, ident: str, text: str, model: ResidueModel) -> DataFrame:
    """(id, score) of the documents of which any sentence, or window along a longer one, is residue by the model; whole texts, no shuffle.

    Null, empty and blank texts are no case. Repeated rows come out as often as they go in; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, known = sent.value, _Vocabulary()
        for batch in batches:
            texts = batch["text"].to_pylist()
            score = np.concatenate([judge.scores(texts[i : i + 500], known) for i in range(0, len(texts), 500)]) if texts else np.zeros(0)
            if len(known) > 500_000:
                known = _Vocabulary()
            hit = pa.array(score >= 0)
            yield pa.RecordBatch.from_arrays([batch["id"].filter(hit), pa.array(score).filter(hit)], ["id", "score"])

    return docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(find, f"id {dict(docs.dtypes)[ident]}, score double")
