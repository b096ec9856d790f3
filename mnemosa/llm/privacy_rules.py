"""Word lists and patterns of the labelers that look for personal information. Fixed values."""

from __future__ import annotations

import re

# Words that announce a kind of item on its left, in English, German, French and Spanish.
NAME_INTRO = (
    r"name(?:'s| is|:)|called|named|i am called|this is|je m'appelle|ich heiße|me llamo|married to|engaged to|related to|held by|belongs to|owned by|signed by|"
    r"contact(?: person)?(?: is|:)|\"contact\": \"|colleague|can reach|ask for|ran into|pregunta por|llama a|demandez|appelle|appelez|"
    r"fragen sie bitte nach|fragen sie nach|ruf|best,|regards,|cheers,|thx,|thanks,|grüße,|cordialement,|saludos,|un saludo,|atentamente,"
)
NAME_LEFT = NAME_INTRO + r"|(?:talked|spoke|write|writes|wrote) (?:to|with)|friend|neighbour|boss|reach|met|with|frag|is"
INTRO_WORDS = frozenset(
    """name called named this appelle heiße llamo married engaged related held belongs owned signed contact colleague reach ask ran pregunta llama
    demandez appelez fragen ruf best regards cheers thx thanks grüße cordialement saludos saludo atentamente
    dr mr mrs ms miss prof professor sir herr frau mme madame mlle monsieur señora señor sra sr doña doctor doctora""".split()
)
TITLES = r"dr|mr|mrs|ms|miss|prof|professor|sir|herr|frau|mme|madame|mlle|monsieur|m|señora|señor|sra|sr|doña|don|doctor|doctora"
NAME_RIGHT = (
    r"says|said|asked|asks|told|tells|thinks|thought|wants|wanted|likes|prefers|called|calls|phoned|wrote|writes|lives|lived|works|worked|uses|came|comes|went|met|moved|rang|"
    r"sagt|sagte|fragt|fragte|meint|meinte|mag|will|wohnt|arbeitet|schreibt|rief|kam|dit|disait|demande|veut|aime|préfère|habite|travaille|écrit|appelle|"
    r"dice|dijo|pregunta|preguntó|quiere|prefiere|vive|trabaja|escribe|llamó|usa|vino"
)
NAME_END = r"at|al|en|au|à|ist|unter|and|will|from|in"
MAIL_LEFT = r"mail|e-mail|email|courriel|mailto|correo|write|schreib|écris|escríbeme|send|cc|contact|uses|usa|reach|or|oder|forward|notes to|préfère|llama"
PHONE_LEFT = (
    r"call|tel|phone|telephone|number|text|reach(?:ed)?|rang|mobile|cell|fax|use|ruf|nummer|telefon|unter|handy|numéro|téléphone|appelle|portable|teléfono|móvil|llama|whatsapp|person is|al"
)
ID_LEFT = (
    r"passport|id|id card|identity|identification|social security|ssn|insurance number|insurance no|national insurance|tax number|tax id|tax|licen[cs]e|form wants|"
    r"ausweis\w*|steuer\w*|personalausweis|reisepass|sécu|sécurité sociale|passeport|carte d'identité|dni|nie|nif|documento|pasaporte|document"
)
ID_RIGHT = r"belongs|is held|and is held|is valid|expires|expired|gehört|läuft ab|abgelaufen|gültig|caduca|caducado|pertenece|périmé|appartient|est à|valable"
NOT_PERSONAL = (
    r"parcel|package|colis|paquete|paket|build|version|versión|ticket|order|invoice|inv|tck|req|mg|price|prix|preis|precio|paid|counted|rows|notes|notas|notizen|"
    r"dossier|incidencia|build \d+|since|gate|room|dock|platform|lane"
)
ADDRESS_LEFT = (
    r"live[sd]?(?: at| in)?|living at|address(?: is|:| on file:)?|flat is at|moved from|moved out of|moved to|to|at|from|ship it to|deliver|send|wants|adresse ist|wohne|bitte an|nicht an|an|"
    r"habite au|habite|livrez plutôt|adresse|au|vivo en|envíalo a|dirección|a|en|and"
)

# Function words that end a name, and file endings that look like domains.
STOP = frozenset(
    """a al am an and as at au aux by con d das de dem den der des die du e el en er es est et for from für i im in is ist je
    la las le les lo los me mi mit my no not o of on or ou para por que sie son sur the to too un und une unter user uses usa von was were will with
    y you your he she they we it its this that these those again still keeps treats last week prefers préfère living said says asked who whose rang called
    if since then there here today tomorrow yesterday monday tuesday wednesday thursday friday saturday sunday please thanks thank what when where why how did do does
    can could would should i'm i'd i've it's that's don't has have had there's my our their his her parcel version build name tel mail best regards cheers thx
    grüße cordialement saludos mr mrs ms dr prof herr frau mme madame monsieur señora señor sra sr doña ok yes no sure hello hi great got tell last more but
    between after before about because while nobody most context session if some any every all para pero como muy está así sehr nicht noch auch aber wenn
    stop street lane row road court ave rd st à ruf demandez appelle appelez pregunta llama frag fragen sie bitte nach
    mañana hoy demain aujourd'hui morgen heute lunes lundi montag sure someone great please honestly sorry van der den""".split()
)
FILE_ENDINGS = frozenset("png jpg jpeg gif svg md txt pdf ics gz zip xlsx docx csv json py js html log yaml yml".split())
PARTICLES = r"(?:mc|mac|van der|van den|van|von der|von|de|del|della|da|di|dos|el|al|ben|bin|ter|zu)"
NUMBER_WORDS = frozenset((
    "zero oh one two three four five six seven eight nine double triple null eins zwo zwei drei vier fünf sechs sieben acht neun "
    "zéro un deux trois quatre cinq six sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve"
).split())

_W = r"[^\W\d_]"
_CAP = rf"(?-i:[A-ZÀ-ÞĀ-Ž]){_W}+"
_TOWN = rf"{_CAP}(?:[-' ](?:(?:am|an|der|les|la|le|de|on|in|sur|upon|lès)[-' ])?{_CAP}\b){{0,3}}"
_ANYTOWN = rf"{_W}+(?:[-' ]{_W}+){{0,3}}?"
_PLACE = rf"(?:,? {_ANYTOWN},? \d{{4,5}}(?!\d)|,? \d{{4,5}} (?:{_TOWN}|{_W}+(?:[-' ]{_W}+){{0,3}}?(?=[,.;!?\n]|$)))"
_UNIT_EN = r"(?:,? (?:apt|apartment|flat|unit|suite|ste|no)\.? ?#?\d+ ?[a-z]?(?!\w)|,? #\d+[a-z]?)"

_AT = "at|arroba"
_DOT = "dot|punkt|point|punto"
EMAIL = re.compile(
    r"(?<![\w.+@-])(?:[\w+-]+(?:\.[\w+-]+)*)(?: ?@ ?|\s*[\[({]\s*(?:@|" + _AT + r")\s*[\])}]\s*)[\w-]+(?:(?:\.|\s*[\[({]\s*(?:\.|" + _DOT + r")\s*[\])}]\s*)[\w-]+)+"
    r"|(?<![\w.+@-])(?:[\w+-]+(?:(?:\.| dot )[\w+-]+)*) (?:" + _AT + r") [\w-]+(?: (?:" + _DOT + r") [\w-]+)+",
    re.I,
)
PHONE = re.compile(
    r"(?<![\w.+@/-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ ./-]?\d{2,5}){1,5}"
    r"|00\d{2}[ .-]?\d{1,3}(?:[ .-]?\d{2,4}){2,5}"
    r"|(?:1[ .-])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-]?)\d{3}[ .-]?\d{4}"
    r"|\(0\d{1,4}\) ?\d{2,8}(?:[ ./-]?\d{2,5}){0,3}|0\d{1,4}[ ./-]?\d{2,8}(?:[ ./-]?\d{2,5}){0,4}"
    r"|(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{3}"
    r")(?:,? ?(?:ext|x|extension|durchwahl|dw|poste|int|anexo)\.? ?\d{1,6})?(?![\w@]|[-/.,:]\d)",
    re.I,
)
SPOKEN = re.compile(rf"\b(?:(?:{'|'.join(sorted(NUMBER_WORDS))})[ -]){{6,}}(?:{'|'.join(sorted(NUMBER_WORDS))})\b(?:,? ?(?:ext|extension)\.? ?\d{{1,6}})?", re.I)
ID = re.compile(
    r"(?<![\w.+@/-])(?:"
    r"[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-z]"
    r"|[a-z]-?\d{7}(?:-?[a-z])?"
    r"|\d{2}\.?\d{3}\.?\d{3}-?[a-z]"
    r"|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?"
    r"|\d{3}[ -]\d{2}[ -]\d{4}"
    r"|\d{2}[ -]\d{4}[ -]\d{4}"
    r"|\d{2} \d{2,3} \d{3} \d{3,4}"
    r"|\d{2} ?\d{6} ?[a-z] ?\d{3}"
    r"|(?=[a-z0-9]*[a-z])(?:[a-z0-9]*\d){5}[a-z0-9]*(?<=[a-z0-9]{9})"
    r"|\d{9,11}"
    r")(?![\w@]|[-/.,:]\w)",
    re.I,
)
_TYPES_EN = r"street|st|lane|ln|row|road|rd|court|ct|avenue|ave|drive|way|close|place|pl|terrace|boulevard|blvd|square|sq|crescent|gardens|mews|hill|walk|green|park"
_ENDINGS_DE = "straße|strasse|str|weg|gasse|platz|allee|ring|damm|ufer|hain"
_STARTS_DE = "am|an der|im|zum|zur|alte|neue|große|kleine|lange|hohe"
_TYPES_FR = r"rue|avenue|av\.|bd|boulevard|impasse|place|allée|chemin|quai|route|cours|square"
_TYPES_ES = r"calle|c/|avda\.?|avenida|av\.|paseo|plaza|pza\.?|camino|ronda|travesía"
_BOXES = r"p\.? ?o\.? ?box|postfach|apartado(?: de correos)?|bp|boîte postale|casilla"
ADDRESS = re.compile(
    r"(?<![\w.:/-])(?:"
    rf"(?:(?:flat|apt|unit|apartment|suite)\.? \d+ ?[a-z]?, )?\d{{1,5}} ?[a-z]?,? (?:{_W}[\w'’-]* ){{1,4}}?(?:{_TYPES_EN})\b\.?(?:{_UNIT_EN})?(?:{_PLACE})?(?:{_UNIT_EN})?"
    rf"|(?:{_W}+(?:{_ENDINGS_DE})(?:(?<=str)\.)?|(?:{_STARTS_DE}) (?-i:[A-ZÄÖÜ]|(?<= )[a-zäöü]){_W}+) \d{{1,4}} ?[a-z]?(?!\w)(?:, (?:\d+\. ?(?:og|stock|etage|ug)|eg|whg\.? ?\d+)\.?)?(?:{_PLACE})?(?:, \d+\. ?(?:og|stock|etage))?"
    rf"|\d{{1,4}}(?:,? ?(?:bis|ter|quater))?,? (?:{_TYPES_FR})\.? (?:(?:de la|des|du|de|la|le|les) |d['’]|de l['’]|l['’])*{_W}[\w'’-]*(?: (?-i:[A-ZÀ-Þ])[\w'’-]+)*(?:,? (?:appt|apt|bât|étage|esc)\.? ?\w+)?(?:{_PLACE})?"
    rf"|(?:{_TYPES_ES}) ?(?:de la |de los |de las |del |de )?{_W}[\w'’-]*(?: {_W}[\w'’-]*)?,? (?:n[º°o]\.? ?)?\d{{1,4}}(?!\d)(?:, (?:\d{{1,2}}[º°ª]\.? ?[a-z]?\b|piso \d+(?: ?[a-z]\b)?|bajo|ático))?(?:{_PLACE})?"
    rf"|(?:{_BOXES}) \d+(?:{_PLACE}|, {_TOWN})?"
    r")",
    re.I,
)


def _literals(alternatives: str) -> tuple[str, ...]:
    """What a text must contain, in lower case, for one of the alternatives to match: the longest literal part of each."""
    found = []
    for alternative in re.split(r"\|(?![^()]*\))", alternatives):
        parts = re.split(r"\(\?:.*?\)\??|.\?|\\.\??", alternative.replace("\\.?", "\0").replace("\\.", "."))
        found.append(max((p for part in parts for p in part.split("\0")), key=len).lower())
    return tuple(sorted(set(found)))


# What the checks before the patterns look for, taken from the patterns' own alternatives. WORDS are whole words there, PARTS may run into others.
INTRO_PARTS = _literals(NAME_INTRO)
TITLE_WORDS = frozenset(TITLES.split("|"))
AT_WORDS, DOT_WORDS = frozenset(_AT.split("|")), frozenset(_DOT.split("|"))
STREET_WORDS = frozenset(w.rstrip(".") for w in _literals(f"{_TYPES_EN}|{_STARTS_DE}|{_TYPES_FR}") if " " not in w)
STREET_PARTS = (*_literals(f"{_TYPES_ES}|{_BOXES}"), *(w for w in _STARTS_DE.split("|") if " " in w))
STREET_ENDINGS = tuple(_ENDINGS_DE.split("|"))
