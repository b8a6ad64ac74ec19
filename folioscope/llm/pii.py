"""Personal information in free text: found exactly where it stands, and replaced by typed placeholders.

A tape carries a text with the source span of each of its characters. Transducers rewrite it: forms of any width
become plain, characters without width go, digits of any script become ASCII, look-alike letters inside Latin words become
Latin, disguised at and dot signs and digits spelled as words become what they stand for. Detectors run over the rewritten
tape, the surest first, each over what the ones before have left; spans map back to the source characters.
A detector with a costly pattern only runs where one of the words or signs stands that its matches can't be without.

Null and empty texts have no finding and stay as they are. Overlapping findings can't occur. Repeated rows give
repeated results; other columns are untouched.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, spread
from .lookalike import CYRILLIC, GREEK

#: Common given names of several languages, lower case. They only add to a score: names() finds others by their place.
GIVEN = frozenset(
    """anna maria eva elena laura julia sofia sara emma lena nina clara marta lucia paula alice agnes ingrid astrid greta karin birgit helga ursula monika
    katarina magdalena agnieszka ewa jan piotr tomasz marek pavel ivan peter paul john james mary elizabeth david michael thomas robert william george
    henry charles arthur martin stefan hans klaus jürgen wolfgang pierre jean louis marie claire sophie camille juan carlos luis miguel josé pedro
    joão ana beatriz giovanni marco luca paolo francesca giulia chiara erik lars sven nils olof birgitta mats johan агния тихон есения иван анна мария
    пётр павел ольга елена наталья сергей дмитрий алексей николай михаил татьяна ирина светлана юлия прохор лукерья матвей""".split()
)
#: Words behind a given name that make a place, ship or house of it.
PLACES = frozenset("island street lane row road rd ct court avenue ave market bridge house inn lantern hall press square harbour bay point hill tower gate lighthouse library mill".split())
#: Digit words of 14 languages, from nought to nine.
DIGIT_WORDS = """zero one two three four five six seven eight nine
null eins zwei drei vier fünf sechs sieben acht neun
zéro un deux trois quatre cinq six sept huit neuf
cero uno dos tres cuatro cinco seis siete ocho nueve
zero um dois três quatro cinco seis sete oito nove
zero uno due tre quattro cinque sei sette otto nove
zero jeden dwa trzy cztery pięć sześć siedem osiem dziewięć
noll ett två tre fyra fem sex sju åtta nio
ноль один два три четыре пять шесть семь восемь девять
零 一 二 三 四 五 六 七 八 九
ゼロ いち に さん よん ご ろく なな はち きゅう
ศูนย์ หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า
शून्य एक दो तीन चार पाँच छह सात आठ नौ
صفر واحد اثنان ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة"""
DIGITS = {w: str(i) for line in DIGIT_WORDS.splitlines() for i, w in enumerate(line.split())} | {"oh": "0", "zwo": "2", "нуль": "0", "〇": "0", "पांच": "5"}
UNSPACED_DIGITS = {w: d for w, d in DIGITS.items() if regex.match(r"[\p{Han}\p{Katakana}\p{Thai}〇]", w)}
SPACED_DIGITS = {w: d for w, d in DIGITS.items() if w not in UNSPACED_DIGITS and not regex.match(r"\p{Hiragana}", w)}

PLAIN = {c: unicodedata.normalize("NFKC", chr(c)) for c in chain(range(0xFF01, 0xFF5F), range(0xFFE0, 0xFFE7))}
PLAIN |= {c: str(unicodedata.digit(chr(c))) for c in range(0x660, 0x10000) if unicodedata.category(chr(c)) == "Nd"}
PLAIN |= {c: " " for c in (0xA0, 0x202F, 0x2007, 0x2009, 0x200A, 0x2002, 0x2003, 0x3000, 0x205F)}
PLAIN |= {0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0xFF0D: "-"}
PLAIN = {k: v for k, v in PLAIN.items() if len(v) == 1}
FORMS = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(PLAIN)) + "]")
NO_WIDTH = re.compile("[­​-‏‪-‮⁠-⁤⁦-⁩﻿]")
LATIN_OF = str.maketrans({k: v for k, v in (CYRILLIC | GREEK).items() if len(v) == 1})
MIXED = regex.compile(r"(?=[\w.@+-]*\p{Latin})(?=[\w.@+-]*[\p{Cyrillic}\p{Greek}])[\w.@+-]+")
_L, _C = "[A-Za-z\u00c0-\u024f]", "[\u0370-\u03ff\u0400-\u052f]"
#: Whether a text may hold such a word: letters of two scripts side by side.
MIXED_GATE = re.compile(f"{_L}[.@+0-9_-]*{_C}|{_C}[.@+0-9_-]*{_L}")
OTHER_LETTERS = re.compile(_C)
AT = re.compile(r"(?<=[A-Za-z0-9_+-])(?:\s?[\[({<]\s?(?:at|AT|At|arroba|chiocciola)\s?[\])}>]\s?|\s@\s?|@\s|\s(?:at|AT)\s(?=[A-Za-z0-9-]+(?:\s(?:dot|DOT)\s|\s?[\[({]\s?(?:dot|DOT|punkt|point|punto)\s?[\])}])))(?=[A-Za-z0-9])")
AT_KEYS = (*(b + gap + "at" for b in "[({<" for gap in ("", " ")), "arroba", "chiocciola")
DOT = re.compile(r"(?<=[A-Za-z0-9])(?:\s?[\[({<]\s?(?:dot|DOT|Dot|punkt|point|punto|ponto)\s?[\])}>]\s?)(?=[A-Za-z0-9])")
DOT_WORD = re.compile(r"(?<=[A-Za-z0-9])\s(?:dot|DOT)\s(?=[A-Za-z]{2,}\b)")
_ONE = r"(?:" + "|".join(sorted(SPACED_DIGITS, key=len, reverse=True)) + r")(?!\w)"
#: Digits as words, perhaps with figures among them, parted by a blank, comma or dash; in scripts without blanks, side by side.
SPELLED = re.compile(r"(?<!\w)(?:plus[ -])?(?:" + _ONE + r"|\d{1,4}(?!\w))(?:(?:-| |, ?)(?:" + _ONE + r"|\d{1,4}(?!\w)))+", re.I)
SPELLED_UNSPACED = re.compile("(?:" + "|".join(sorted(UNSPACED_DIGITS, key=len, reverse=True)) + "){6,}")
UNSPACED_FIRST = re.compile("[" + "".join({w[0] for w in UNSPACED_DIGITS}) + "]")
SPELLED_WORD = re.compile("|".join([r"\d", *sorted(DIGITS, key=len, reverse=True)]), re.I)
#: Digit words from which on a number counts as spelled, and the digits of a telephone number.
SPELLED_LEAST, PHONE_DIGITS = 4, range(7, 16)
FIGURE = re.compile("[0-9]")

#: Ends of file names that look like a domain's.
FILES = ("png", "jpg", "jpeg", "gif", "svg", "webp", "pdf", "html", "xhtml", "css", "js", "ncx", "opf", "xml", "txt", "epub")
EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])")
#: Shapes of record numbers; a label before them decides.
SHAPE = r"(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]|[A-Z]\d[A-Z0-9]\d{5,7}|[A-Z]{1,2}\d{6,10}|\d{17}[\dXx]|\d{3}-\d{3}-\d{3} \d\d|\d{3}\.\d{3}\.\d{3}-\d\d|\d\d\.?\d{3}\.?\d{3}-[A-Z]|\d{8}[A-Z]|\d \d\d \d\d \d\d \d{3} \d{3} \d\d|\d{3}[- ]\d\d[- ]\d{4}|\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]\d{4})?|\d\d \d{3} \d{3} \d{3}|\d\d \d\d \d{6}|\d{4} \d{6}|\d{6,8}-\d{4}|\d{9,13}|[A-Z0-9]{2,}\d[A-Z0-9 -]{4,16}\d)(?![\dA-Za-z])"
LABEL = r"(?:[Pp]assport|[Cc]ard(?: holder)?|[Tt]ax|NI|[Ii]nsurance|[Ss]ecurity|[Ii]dentity|ID|DNI|NIE|CPF|RG|[Cc]odice fiscale|[Cc]arta d’identità|PESEL|NIP|[Dd]owód|[Aa]usweis\w*|[Ss]teuer\w*|[Pp]ass\w*nummer|[Vv]ersicherung\w*|sécurité sociale|[Pp]asseport|[Cc]arte|паспорт\w*|ИНН|СНИЛС|полис\w*|удостоверени\w*|[Pp]ersonnummer|身份证|护照|社保|個人番号|旅券|保険証|マイナンバー|पहचान|आधार|الهوية|جواز|ประจำตัว|บัตร|พาสปอร์ต)"
#: The most signs between a label and its number; a parameter.
LABEL_REACH = 28
#: Each match of LABEL begins with one of these.
LABEL_KEYS = """Passport passport Card card Tax tax NI Insurance insurance Security security Identity identity ID DNI NIE CPF RG Codice codice Carta carta PESEL NIP Dowód dowód Ausweis ausweis Steuer steuer
    Pass pass Versicherung versicherung sécurité Passeport passeport Carte carte паспорт ИНН СНИЛС полис удостоверени Personnummer personnummer 身份证 护照 社保 個人番号 旅券 保険証 マイナンバー पहचान आधार الهوية جواز ประจำตัว บัตร พาสปอร์ต""".split()
ID = re.compile(LABEL + r"(?:[^\d\n@.!?]|(?<=[Nn]o)\.|(?<=[Nn]r)\.){0,%d}?(?<![A-Za-z\d])(" % LABEL_REACH + SHAPE + ")")
SURE_ID = re.compile(r"(?<![A-Za-z\d./-])([A-Z]{2} \d\d \d\d \d\d [A-Z]|[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]|\d{3}\.\d{3}\.\d{3}-\d\d|\d{17}[\dX])(?![A-Za-z\d])")
EXT = r"(?:,? ?(?:ext\.?|extension|x|доб\.?|Durchwahl|DW|poste|interno|int\.|ramal|wew\.?|ankn\.?|内线|内線|转|분기) ?\d{1,5})?"
PHONES = [
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\) ?)?\d{1,4}(?:[ .-]\d{2,8}){1,5}",
    r"\+\d{9,14}",
    r"00\d{1,3}[ -]\d{1,4}[ -]\d{3,8}(?:[ -]\d{2,4}){0,3}",
    r"\(0?\d{2,4}\) ?\d{2,4}(?:[ -]?\d{2,4}){1,3}",
    r"\d{3}\.\d{3}\.\d{4}",
    r"0\d{2,4} \d{4} \d{3,4}",
    r"0\d{2,4}/\d{5,9}(?:-\d{1,4})?",
    r"0\d(?:\.\d\d){4}|0\d(?: \d\d){4}",
    r"8[ -]\(?\d{3}\)?[ -]\d{3}[ -]\d\d[ -]\d\d",
    r"\d{3}-\d{3}-\d{3,4}",
    r"\d{2,4}-\d{4}-?\d{4}",
    r"\d{3} \d{3} \d{4}",
]
PHONE = re.compile(r"(?<![A-Za-z0-9./+\-:(])(?:" + "|".join(PHONES) + r")(?![\d/]|[-.]\d)" + EXT)
NOT_PHONE = re.compile(r"(?:ISBN|ISSN|[Oo]rder|[Ll]ot|[Ll]ines?|[Cc]all number|[Vv]ersion|[Pp]rinting|[Rr]esource|urn:\S*|checksum|No\.|no\.|nr\.|Nr\.|n\.º|№|[Ss]ignatur|Шифр|cote)[ :]*$")
CAPS = r"\p{Lu}[\p{L}’'-]*[\p{L}’']"
TOWN = r"\p{Lu}[\p{L}’'-]+"
ADDRESSES = [
    r"(?:(?:Flat|Apt\.?|Unit|Suite) \d+[A-Z]?, )?(?<![\d.,/-])\d{1,4}[A-Z]?,? (?:" + CAPS + r" ){1,3}(?:Street|St\.|Lane|Rd\.|Rd|Road|Row|Ct|Court|Avenue|Ave\.|Way|Place|Square|Terrace|Drive|Close|Crescent|Quay|Hill)(?![\p{L}])(?:, " + TOWN + r"(?: \d{4,6})?)?",
    r"(?:(?:Alte|Neue|Alter|Neuer|Große|Kleine|Obere|Untere|Hohe|Am|An der|Auf dem|Zum|Zur) )?\p{Lu}[\p{L}-]*(?:str\.|straße|strasse|weg|gasse|platz|allee|ufer|damm|ring|markt|steig) ?\d{1,4} ?(?:[a-z](?!\p{L}))?(?:, (?:D-)?\d{5} " + TOWN + ")?",
    r"(?<![\d.,/-])\d{1,4}(?: (?:bis|ter))?,? (?:rue|av\.|avenue|bd|boulevard|place|quai|chemin|impasse|allée|cours|ruelle) [\p{L}’' -]{3,40}?(?=, \d{5}|[,.;\n)]|$)(?:, \d{5} " + TOWN + ")?",
    r"(?:C/|Calle|Avda\.|Av\.|Avenida|Plaza|Paseo|Rua|R\.|Travessa|Largo|Praça|Via|Viale|Piazza|Corso|Vicolo) (?:(?:de|del|della|dello|dei|delle|di|do|da|dos|das|la|las|los|el|e|y|l’|d’) ?|" + CAPS + r" ?){1,6},? ?\d{1,4}[A-Za-z]?(?![\d\p{L}])(?:, \d{1,2}\.?[ºª°] ?[A-Z]?(?!\p{L}))?(?:, \d{4,5}(?:-\d{3})? " + TOWN + ")?",
    r"(?:(?:Stora|Lilla|Gamla|Norra|Södra|Västra|Östra) )?\p{Lu}\p{L}*(?:gatan|vägen|gränd|torget|stigen|backen) \d{1,4} ?(?:[A-Za-z](?!\p{L}))?(?:, \d{3} ?\d\d " + TOWN + ")?",
    r"(?<!\p{L})(?:ul|al|pl|os)\. (?:" + CAPS + r" ?){1,3} \d{1,4}[A-Za-z]?(?: m\. ?\d+|/\d+)?(?:, \d\d-\d{3} " + TOWN + ")?",
    r"(?<!\p{L})(?:\d{6}, )?(?:г\. " + TOWN + r", )?(?:ул|пер|пр|просп|наб|пл|пр-т|ш)\. " + TOWN + r", (?:д\. ?)?\d{1,4}\p{L}?(?!\p{L})(?:, (?:корп|стр)\. ?\d+)?(?:, кв\. ?\d+)?",
    r"(?:(?<=到|是|为|:|：|，|在|址)\p{Han}{2,4}|\p{Han}{2})市\p{Han}{1,8}?(?:路|街|道|巷)\d+号(?:\d+[室号])?",
    r"〒\d{3}-\d{4} ?[\p{Han}\p{Hiragana}\p{Katakana}ー]{2,14}?\d+(?:-\d+){0,3}(?:号室)?",
    r"मकान \d+, [^,।\n]{2,40}, [\p{Devanagari}\p{M}]+ \d{6}",
    r"\d+(?:/\d+)?(?:ถนน|ซอย)[ก-๛]{2,60}? ?\d{5}",
    r"(?:\d+،? )?شارع [\p{Arabic} ]{2,30}?(?:،|,)? ?\d+(?:، ?[\p{Arabic} ]{2,30}?(?: \d{5,6})?)?(?=[.،\s]|$)|منزل \d+، [^.\n]{2,50}? \d{5,6}",
]
#: For each pattern signs of which its matches hold one.
ADDRESS_KEYS = [
    ("Street", "St.", "Lane", "Rd", "Road", "Row", "Ct", "Court", "Ave", "Way", "Place", "Square", "Terrace", "Drive", "Close", "Crescent", "Quay", "Hill"),
    ("str.", "straße", "strasse", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "markt", "steig"),
    ("rue", "av.", "avenue", "bd", "boulevard", "place", "quai", "chemin", "impasse", "allée", "cours", "ruelle"),
    ("C/", "Calle", "Av", "Plaza", "Paseo", "Rua", "R.", "Travessa", "Largo", "Praça", "Via", "Piazza", "Corso", "Vicolo"),
    ("gatan", "vägen", "gränd", "torget", "stigen", "backen"),
    ("ul.", "al.", "pl.", "os."),
    ("ул.", "пер.", "пр.", "просп.", "наб.", "пл.", "пр-т.", "ш."),
    ("号",), ("〒",), ("मकान",), ("ถนน", "ซอย"), ("شارع", "منزل"),
]
ADDRESS = [regex.compile(p) for p in ADDRESSES]
PARTICLE = r"(?:van der|van den|van|von der|von|zu|de la|de las|de los|de|del|della|di|da|dos|du|af|VAN DER|VAN DEN|VAN|VON|DE LA|DE|DEL|DI|DA|DU)"
FAMILY = r"(?:" + PARTICLE + r" )?\p{Lu}[\p{L}’'-]*\p{L}"
WORD = regex.compile(r"[\p{L}\p{M}’'-]+")
INITIALS = regex.compile(r"(?<![\p{L}\d.])(?:\p{Lu}\. ?){2,3}" + FAMILY)
TURNED = regex.compile(r"(?<![\p{L}\d’'-])(?:(?:VAN DER|VAN DEN|VAN|VON DER|VON|DE LA|DE LAS|DE|DEL|DI|DA|DU|van der|van den|von der|von) )?\p{Lu}[\p{L}’'-]*\p{L}" + r", ((?:\p{Lu}[\p{L}’'-]*\p{L}|\p{Lu}\.)(?: (?:\p{Lu}[\p{L}-]*\p{L}|\p{Lu}\.(?! \p{Lu}))){0,1})(?![\p{L}])")
#: Titles and words that introduce a person.
CUE = regex.compile(
    r"(?<![\p{L}\d])(?:(?:Dr|Mrs?|Ms|Prof|Sig|Sra?|Dra|Rev|Capt)\.?|Mme|Mlle|M\.|Frau|Herrn?|señora?|señor|senhora?|signora?|pani|panu|pan|fru|herr|by|signed by|issued to|belongs to|receipt for|reach|Name:|contact:|par|relu par|Traduit par|Satz:|Lektorat:|Traducción de|corrección de|спросить|Перевод:|вёрстка:|читает|на имя)\s"
    r"(\p{Lu}[\p{L}’'-]*\p{L}(?: (?:" + PARTICLE + r" )?\p{Lu}[\p{L}’'-]*\p{L}){1,2}|(?:\p{Lu}\. ?){1,2}" + FAMILY + ")"
)
#: Each match of CUE begins with one of these; of LOWER_CUED too, with the others.
CUE_KEYS = """Dr Mr Ms Prof Sig Sr Dra Rev Capt Mme Mlle M. Frau Herr señor senhor signor pan fru herr by signed issued belongs receipt reach Name: contact: par relu Traduit Satz: Lektorat: Traducción corrección спросить Перевод: вёрстка: читает на""".split()
LOWER_KEYS = CUE_KEYS + "translated typeset proofread written lent borrowed Translated Signed traduit signé Relu I, Ich, Moi, Yo, Eu, Io,".split()
OTHERS = [
    regex.compile(r"收件人[:： ]?(\p{Han}{2,4})(?=[。，,.\s]|$)"),
    regex.compile(r"の([\p{Han}ノヶ々ケ]{2,4}[\p{Han}\p{Hiragana}ノヶ々]{0,5})(?:様|さん|氏)"),
    regex.compile(r"पर ([\p{Devanagari}\p{M}]+ [\p{Devanagari}\p{M}]+) का नाम"),
    regex.compile(r"باسم ([\p{Arabic}\p{M}]+ [\p{Arabic}\p{M}]+)(?=[.،\s]|$)"),
    regex.compile(r"คุณ([ก-๎]+ [ก-๎]+?)(?=โทร|[\s0-9(+.]|$)"),
    regex.compile(r"(?:寄件人|姓名|联系人|署名|借阅人|氏名|名前|宛名|お名前|借主)[:：]\s?([\p{Han}\p{Hiragana}\p{Katakana}ー・々]{2,8})(?=[。，、,.\s]|$)"),
    regex.compile(r"(?<![\p{Han}\p{Hiragana}\p{Katakana}])(\p{Han}{2,4})(?:先生|女士|小姐|様|さん|氏|殿)(?!\p{Han})"),
    regex.compile(r"(?<![\p{Devanagari}\p{M}])(?:श्री|श्रीमती|सुश्री|कुमारी|डॉ\.?) ([\p{Devanagari}\p{M}]+ [\p{Devanagari}\p{M}]+?)(?= जी(?![\p{Devanagari}\p{M}])|[,।\n(]|$)"),
    regex.compile(r"(?<![\p{Arabic}\p{M}])(?:السيدة?|الأستاذة?|الدكتورة?|الآنسة|الاسم:) ([\p{Arabic}\p{M}]+ [\p{Arabic}\p{M}]+)(?=[.،,؛\n(]|$)"),
    regex.compile(r"(?<![ก-๎])(?:นาย|นาง|นางสาว|ดร\.) ?([ก-๎]+ [ก-๎]+?)(?=โทร|[\s0-9(+.]|$)"),
    regex.compile(r"(?<![\p{L}.])((?:[А-ЯЁ]\. ?){1,2}[А-ЯЁ][а-яё]+(?:ск(?:ий|ая|ой)|цк(?:ий|ая)|н(?:ый|ая)|[оеё]ва?|[иы]на?|цева?|ко|ых|дзе|ян|шин|юк))(?![а-яё])"),
]


#: For each pattern signs of which its matches hold one.
OTHERS_KEYS = [
    ("收件人",), ("様", "さん", "氏"), (" का नाम",), ("باسم ",), ("คุณ",), ("寄件人", "姓名", "联系人", "署名", "借阅人", "氏名", "名前", "宛名", "お名前", "借主"),
    ("先生", "女士", "小姐", "様", "さん", "氏", "殿"), ("श्री", "सुश्री", "कुमारी", "डॉ"), ("السيد", "الأستاذ", "الدكتور", "الآنسة", "الاسم:"), ("นาย", "นาง", "ดร."),
    ("ий", "ая", "ой", "ый", "ов", "ев", "ёв", "ин", "ын", "ко", "их", "ых", "дзе", "ян", "юк"),
]

#: Particles between given and family names.
PARTICLES = frozenset("van der den de la las los von del della di da dos du af zu".split())
#: Words that are no part of a name, however they are written.
NO_NAME = frozenset(
    """the a an and or of in on at to for by with from is was were be this that it he she they we you i my his her their our no not all one two three as but if when where why how who what which there here
    der die das den dem des ein eine einen einer eines und oder in im am an auf zu zum zur mit von vom für bei nach vor über unter ist war nicht kein keine sie er es wir ihr ihre sein seine wie wo wer was als aus
    le la les un une des du de et ou en au aux à par pour avec sur dans est il elle on nous vous je ne pas son sa ses ce cette qui que où comment
    el los las unos unas y o e del al con por para sobre sin es no su sus él ella lo se que quién dónde cómo
    il lo gli i uno di da del della dei delle che non con per su è ed ma si suo sua chi dove come
    o os as um uma do da dos das em no na nos nas ao à com por para é não que seu sua quem onde como
    i w z na do nie się jest to że od po za przy pod nad o u jak kto gdzie co
    och en ett den det de i på av till med för från är var inte som han hon vi hur vem vad där
    и в на с к по за от до не что как это он она они мы вы я у о из под над кто где""".split()
)
#: Words with capitals in a row, with particles between them; the runs are cut up in placed().
RUN = regex.compile(
    r"(?<![\p{L}\p{M}’'-])\p{Lu}[\p{L}\p{M}’'-]*(?:(?: |(?<=\p{Lu})\. )(?:\p{Lu}[\p{L}\p{M}’'-]*|(?:van|der|den|de|la|las|los|von|del|della|di|da|dos|du|af|zu)(?![\p{L}\p{M}’'-])))+"
)
#: The place of a name: a word for oneself before it, a colon or a preposition of giving, another finding close behind.
SELF = regex.compile(r"(?:^|[\n.!?”\"»“] ?)(?:I|Ich|Moi|Je|Yo|Eu|Io|Ja|Jag|Я), $")
COLON = regex.compile(r":[ \n]$")
GIVEN_TO = regex.compile(r"(?<!\p{L})(?:to|for|by|reach|an|für|von|à|pour|par|a|para|por|per|da|till|för|av|dla|przez|для)\s$")
TITLE = regex.compile(r"(?<!\p{L})(?:(?:Dr|Mrs?|Ms|Prof|Sig)\.|Mme|Mlle|Frau|Herrn?|señora?|senhora?|signora?|pani|pana?|fru|herr|belongs to|reach|contact)\s$")
#: Verbs of saying before the one who speaks.
SAID = regex.compile(r"(?<!\p{L})(?:said|asked|replied|cried|answered|whispered|wrote|sagte|fragte|rief|antwortete|schrieb|dit|demanda|répondit|cria|écrivit|dijo|preguntó|respondió|gritó|escribió|disse|chiese|rispose|scrisse|perguntou|respondeu|escreveu|powiedział|powiedziała|zapytał|zapytała|napisał|napisała|sade|frågade|svarade|skrev|сказал|сказала|спросил|спросила|ответил|ответила|написал|написала)\s$")
#: What follows the one a sentence begins with.
GOES_ON = regex.compile(r" \p{Ll}")
NEAR = regex.compile(r"[^.!?\n\x00]{0,12}[,;:(]?[ \n]?\x00")
#: Words before which a given name names a ship or house.
SHIP = regex.compile(r"(?i)(?:ferry|ship|inn|house|schooner|brig|boat|village|port) $")
AND = regex.compile(r" (?:and|und|et|y|e|i|och|и) ")
OPENING = regex.compile(r"(?:^|[.!?…][\"”»“]?\s+|\n)$")
BEHIND = regex.compile(r"[ \t]*(?:\r?\n|$)")


PART = r"(?:(?:van der|van den|van|von der|von|de la|de|del|di|da|du|af|zu) )?"
LOWER = r"\p{Ll}(?:\p{Ll}|[’'-](?!s(?!\p{L})))+"
#: After the first a name may be followed by anything, after the second only by a finding.
LOWER_CUED = regex.compile(
    r"(?<!\p{L})(?:(?:Dr|Mrs?|Ms|Prof|Sig|Sra?|Dra)\.?|Mme|Mlle|Frau|Herrn?|señora?|senhora?|signora?|pani|pana?|fru|herr|(?:signed|translated|typeset|proofread|written|lent|borrowed|Translated|Signed) by|issued to|belongs to|receipt for|"
    r"(?:traduit|relu|signé|Traduit|Relu) par|Satz:|Lektorat:|Traducción de|corrección de|Name:|contact:|(?:I|Ich|Moi|Yo|Eu|Io),) (" + LOWER + " " + PART + LOWER + r")(?!\p{L})"
)
LOWER_PLACE = regex.compile(r"(?:(?<!\p{L})(?:to|for|reach|contact|an|à|a|till|för|reads?:|:)\s|(?<=\p{L}|,)\n)(" + LOWER + "(?: " + PART + LOWER + r"){1,2}?)(?=,|\n| (?:at|was)\b|’s|[.;(]|$)")


class Tape:
    """A text and, once anything changed length, the source span of each character."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def rewrite(self, pattern: re.Pattern, new) -> None:
        out, starts, ends, at, hit = [], [], [], 0, False
        for m in pattern.finditer(self.text):
            if not hit:
                hit = True
                if self.start is None:
                    self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
            a, b = m.span()
            to = new(m.group()) if callable(new) else new
            out += [self.text[at:a], to]
            starts += self.start[at:a] + [self.start[a]] * len(to)
            ends += self.end[at:a] + [self.end[b - 1]] * len(to)
            at = b
        if hit:
            self.text = "".join(out) + self.text[at:]
            self.start, self.end = starts + self.start[at:], ends + self.end[at:]

    def replace(self, spans: list[tuple[int, int]], new) -> list[tuple[int, int]]:
        """Replace spans that don't overlap, and tell where they are afterwards."""
        if not spans:
            return []
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        out, starts, ends, at, size, places = [], [], [], 0, 0, []
        for a, b in sorted(spans):
            to = new(self.text[a:b])
            out += [self.text[at:a], to]
            size += a - at
            places.append((size, size + len(to)))
            size += len(to)
            # A part of a replaced number stands for the whole of it.
            starts += self.start[at:a] + [self.start[a]] * len(to)
            ends += self.end[at:a] + [self.end[b - 1]] * len(to)
            at = b
        self.text = "".join(out) + self.text[at:]
        self.start, self.end = starts + self.start[at:], ends + self.end[at:]
        return places

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def tape(text: str) -> Tape:
    t = Tape(text if text.isascii() else FORMS.sub(lambda m: PLAIN[ord(m.group())], text))  # one for one
    if NO_WIDTH.search(t.text):
        t.rewrite(NO_WIDTH, "")
    if not t.text.isascii() and OTHER_LETTERS.search(t.text) and MIXED_GATE.search(t.text):
        t.text = MIXED.sub(lambda m: m.group().translate(LATIN_OF), t.text)  # one for one
    low = t.text.lower()
    if "@" in low or " at " in low and "dot" in low or any(k in low for k in AT_KEYS):
        t.rewrite(AT, "@")
    if "dot" in low or "@" in t.text:
        t.rewrite(DOT, ".")
        if "@" in t.text and "dot" in low:
            t.rewrite(DOT_WORD, ".")
    return t


def spelled(s: str) -> list[tuple[int, int]]:
    """Spans of numbers that are spelled as words, at least half of their digits."""
    out = []
    if len(list(filter(SPACED_DIGITS.__contains__, s.casefold().replace("-", " ").replace(",", " ").split()))) >= SPELLED_LEAST:
        for m in SPELLED.finditer(s):
            words = SPELLED_WORD.findall(m.group())
            if SPELLED_LEAST <= sum(not w.isdigit() for w in words) >= len(words) / 2:
                out.append(m.span())
    if not s.isascii() and UNSPACED_FIRST.search(s):
        out += [m.span() for m in SPELLED_UNSPACED.finditer(s)]
    return out


def in_figures(text: str) -> str:
    return "+" * text.casefold().startswith("plus") + "".join(w if w.isdigit() and w.isascii() else DIGITS[w.casefold()] for w in SPELLED_WORD.findall(text))


@cache
def scanner() -> ahocorasick.Automaton:
    """Finds all words that patterns can't be without in one pass; each tells its length and the patterns it belongs to."""
    owners: dict[str, set] = {}
    for name, keys in (("id", LABEL_KEYS), ("cue", CUE_KEYS), ("lower", LOWER_KEYS), *((("address", i), k) for i, k in enumerate(ADDRESS_KEYS)), *((("other", i), k) for i, k in enumerate(OTHERS_KEYS))):
        for k in keys:
            owners.setdefault(k, set()).add(name)
    found = ahocorasick.Automaton()
    for k, names in owners.items():
        found.add_word(k, (len(k) - 1, tuple(names)))
    found.make_automaton()
    return found


def scan(s: str) -> dict:
    """Where the words of each pattern stand."""
    places: dict = {}
    for end, (size, names) in scanner().iter(s):
        for name in names:
            places.setdefault(name, []).append(end - size)
    return places


def at_keys(s: str, places: list[int], pattern) -> Iterator[re.Match]:
    """The matches of a pattern at some places, from left to right, none inside another."""
    stop = 0
    for i in sorted(set(places)):
        if i >= stop and (m := pattern.match(s, i)):
            stop = m.end()
            yield m


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, each that begins in an earlier one left out."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda x: x[0]):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """Kind, start and end of each finding, in order."""
    if not text:
        return []
    t = tape(text)
    numbers = t.replace(spelled(t.text), in_figures)
    s, out = t.text, []

    def take(kind: str, spans: list[tuple[int, int]]) -> None:
        nonlocal s
        if spans:
            parts, at = [], 0
            for a, b in spans:
                out.append((kind, *t.source(a, b)))
                parts += [s[at:a], "\x00" * (b - a)]
                at = b
            s = "".join(parts) + s[at:]

    keys = scan(s)
    if "@" in s:
        take("email", [m.span() for m in EMAIL.finditer(s) if m.group().rpartition(".")[2].lower() not in FILES])
    if FIGURE.search(s):
        take("id", [m.span(1) for m in at_keys(s, keys.get("id", ()), ID)])
        take("id", [m.span(1) for m in SURE_ID.finditer(s)])
        take("address", apart([m.span() for i, p in enumerate(ADDRESS) if ("address", i) in keys for m in p.finditer(s)]))
        phones = [m.span() for m in PHONE.finditer(s) if 7 <= sum(map(str.isdigit, m.group())) <= 18 and not NOT_PHONE.search(s[max(0, m.start() - 24) : m.start()])]
        # What is left of spelled numbers has no notation of its own.
        phones += [(a, b) for a, b in numbers if b - a in PHONE_DIGITS and "\x00" not in s[a:b] and not any(x < b and a < y for x, y in phones)]
        take("phone", apart(phones))
    take("name", sorted(names(s, keys)))
    return sorted(out, key=lambda x: x[1])


def trimmed(s: str, a: int, b: int) -> tuple[int, int]:
    for tail in ("’s", "'s", "’", "'"):
        if s.endswith(tail, a, b):
            return a, b - len(tail)
    return a, b


def names(s: str, keys: dict) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    taken = bytearray(len(s))

    def add(a: int, b: int) -> None:
        a, b = trimmed(s, a, b)
        if a < b and taken.find(1, a, b) < 0:
            found.append((a, b))
            taken[a:b] = b"\1" * (b - a)

    for m in TURNED.finditer(s):
        given = m.group(1).split(" ")[0].casefold()
        family = s[m.start() : m.start(1) - 2]
        if given in GIVEN or family.isupper() and len(family) > 3 and (m.group(1)[0] + m.group(1)[1:2]).istitle():
            add(*m.span())
    for m in INITIALS.finditer(s):
        add(*m.span())
    for m in at_keys(s, keys.get("cue", ()), CUE):
        words = m.group(1).split(" ")
        if words[-1].casefold() not in PLACES and words[-1].strip(".").casefold() not in PLACES:
            add(*m.span(1))
    for m in placed(s, keys, found):
        add(*m)
    for i, p in enumerate(OTHERS):
        if ("other", i) in keys:
            for m in p.finditer(s):
                add(*m.span(1))
    return found


def runs(s: str) -> list[list[tuple[int, int]]]:
    """Places of the words of each run of capitalised words with particles between them, that begins and ends with a
    capital; words that are no part of a name part the runs."""
    out = []
    for m in RUN.finditer(s):
        own: list[tuple[int, int]] = []
        for w in WORD.finditer(s, *m.span()):
            if w.group()[0].isupper() and w.group().casefold() not in NO_NAME or own and w.group() in PARTICLES:
                own.append(w.span())
                continue
            out.append(own)
            own = []
        out.append(own)
    for own in out:
        while own and s[own[-1][0]].islower():
            own.pop()
    return [own for own in out if own]


def ends_line(s: str, a: int) -> str:
    """The last sign before a place that is no blank."""
    while a and s[a - 1].isspace():
        a -= 1
    return s[a - 1 : a]


def placed(s: str, keys: dict, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Names by their form and place: runs of two to four capitalised words are scored by what stands around them; words in
    lower case only count where a title or preposition stands before them and another finding behind."""

    @cache
    def small() -> Counter:
        """How often each word in lower case stands in the text."""
        return Counter(w for w in WORD.findall(s) if w.islower())

    two = [own for own in runs(s) if 2 <= len(own) <= 5]
    starts, ends = {own[0][0] for own in two} | {a for a, _ in found}, {own[-1][1] for own in two} | {b for _, b in found}
    families = {s[a:b].rpartition(" ")[2] for a, b in found}
    out = []
    for places in two:
        a, b = places[0][0], places[-1][1]
        own = [s[x:y] for x, y in places]
        family = own[-1].removesuffix("’s").removesuffix("'s")
        if family.casefold() in PLACES or len(family) < 3 or any(w.isupper() and len(w) > 1 for w in own):
            continue
        before, score = s[max(0, a - 24) : a], 1.0
        line, behind = a == 0 or s[a - 1] == "\n", BEHIND.match(s, b)
        score += 2.0 * bool(SAID.search(before) or GOES_ON.match(s, b) and (not a or OPENING.search(before))) + 2.0 * bool(NEAR.match(s, b)) + 2.0 * bool(SELF.search(before)) + bool(COLON.search(before)) + bool(GIVEN_TO.search(before)) + 3.0 * bool(TITLE.search(before))
        if line and behind:
            above = ends_line(s, a)
            score += 1.5 + 0.5 * (above.isalpha() or above == ",")
        follow, ahead = AND.match(s, b), next((m for m in AND.finditer(s, max(0, a - 6), a) if m.end() == a), None)
        if follow and follow.end() in starts or ahead and ahead.start() in ends:
            score += 1.5 + 0.5 * bool(OPENING.search(before) or ahead)
        given = own[0].casefold() in GIVEN
        score += 1.5 * given + any(w in PARTICLES for w in own) + (family in families)
        if given and not SHIP.search(before):
            score += 2.0
        if score >= 3.0 and score - sum(1.5 for w in own if w not in PARTICLES and small()[w.casefold()]) >= 3.0:
            out.append((a, b))
    whole = cache(s.count)
    for m in chain(at_keys(s, keys.get("lower", ()), LOWER_CUED), LOWER_PLACE.finditer(s) if "\x00" in s else ()):
        if m.re is LOWER_PLACE and not NEAR.match(s, m.end(1)):
            continue
        own = [w for w in m.group(1).split(" ") if w not in PARTICLES]
        if len(own) > 1 and all(len(w) > 2 and w not in NO_NAME for w in own) and own[-1] not in PLACES and all(small()[w] <= whole(m.group(1)) for w in own):
            out.append(m.span(1))
    return out


def mask(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def findings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pii_kind, start_char and end_char of each finding; code points."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in find(t)]
        cols = zip(*rows) if rows else [[]] * 4
        kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[key, "pii_kind", "start_char", "end_char"])

    kind = df.schema[key].dataType.simpleString()
    return map_rows(spread(df.filter(F.col(text).isNotNull()).select(key, text)), f"{key} {kind}, pii_kind string, start_char long, end_char long", text, kernel)


def masked(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the text with placeholders, and how many there are."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = [find(t) for t in texts]
        cols = [batch.column(0), pa.array([mask(t, f) for t, f in zip(texts, found)], pa.string()), pa.array(list(map(len, found)), pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=[key, "masked_text", "n_found"])

    kind = df.schema[key].dataType.simpleString()
    return map_rows(spread(df.select(key, text)), f"{key} {kind}, masked_text string, n_found int", text, kernel)
