"""Classification by written rules: per field an ordered list of rules, the first that fits wins.

A rule is ``(kind, label, phrases)`` on the lower-cased value: ``exact``, ``prefix``, ``word``
(a phrase that no letter a-z or digit touches), ``within`` (substring) or ``pattern``. Rules are
turned into conditions of one expression, so classifying needs no join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import CATCH_ALL

Rule = tuple[str, str, tuple[str, ...]]

# The written rules, in order of precedence.
_STATUS: tuple[Rule, ...] = (
    (
        "exact",
        "Pending / Insolvency",
        (
            "in administration", "liquidation", "receivership", "voluntary arrangement", "insolvenzverfahren eröffnet", "redressement judiciaire",
            "liquidation judiciaire", "active – dissolution pending", "intent to dissolve", "active – proposal to strike off", "judicial management",
            "winding up", "strike-off in progress", "external administration", "suspended", "revoked", "delinquent", "forfeited", "in default",
            "pending revocation", "in reorganization", "pending", "merged", "amalgamated", "converted", "successor", "consolidated", "withdrawal",
            "redomesticated", "transferred",
        ),
    ),
    ("exact", CATCH_ALL, ("unknown", "not provided", "default", "null", "refer to ministry of finance", "refer to governing legislation", "start")),
    ("word", "Inactive", ("inactive", "dissolved", "struck off", "cancelled", "deregistered", "liquidated", "closed", "terminated", "ceased", "wound up", "removed", "uitgeschreven")),
    (
        "word",
        "Pending / Insolvency",
        (
            "administration", "liquidation", "receivership", "voluntary arrangement", "insolvenzverfahren", "redressement judiciaire", "pending", "intent to dissolve",
            "strike off", "strike-off", "judicial management", "winding up", "suspended", "revoked", "delinquent", "forfeited", "in default", "reorganization",
            "merged", "amalgamated", "converted", "consolidated", "withdrawal", "redomesticated", "transferred",
        ),
    ),
    (
        "word",
        "Active",
        (
            "active", "active-operating", "good standing", "current", "live", "normal", "in compliance", "registered", "incorporated", "formed", "recorded", "immatriculée", "situation normale",
        ),
    ),
)

RULES: dict[str, tuple[Rule, ...]] = {
    "business_status": _STATUS,
    "ownership_relationship_status": _STATUS,
    "directors_officers_status": (
        ("word", CATCH_ALL, ("inactive", "refer to", "unknown")),
        ("word", "Resigned", ("resigned", "terminated", "removed", "retired", "ceased", "former", "left", "stepped down")),
        ("word", "Active", ("active", "current", "serving", "appointed", "in office")),
    ),
    "directors_officers_type": (
        ("prefix", "Business", ("corporate-",)),
        (
            "word",
            "Individual",
            ("director", "secretary", "nominee-director", "nominee-secretary", "llp-designated-member", "llp-member", "managing-officer", "officer", "member", "chairman", "treasurer", "president"),
        ),
    ),
    "business_entity_type": (
        ("exact", CATCH_ALL, ("unknown",)),
        ("word", "Business", ("business", "company", "corporation", "entity", "legal entity", "organisation")),
        ("word", "Individual", ("individual", "person", "natural person", "director", "secretary")),
    ),
    "ownership_relationship_type": (
        ("prefix", "Business", ("corporate-",)),
        ("pattern", CATCH_ALL, ("^[0-9]+$", "^.$")),
        (
            "exact",
            "Individual",
            (
                "individual", "person", "proprietor", "shareholder", "voting shareholder", "persons of significant control", "individual-person-with-significant-control",
                "individual-beneficial-owner", "legal representative",
            ),
        ),
        (
            "exact",
            "Business",
            (
                "company", "corporation", "business name", "business name owner", "parent", "global ultimate parent", "ultimate beneficial owner", "share ownership",
                "unidentified share ownership", "legal-person-beneficial-owner",
            ),
        ),
        ("word", CATCH_ALL, ("class", "series", "common", "pref", "shares", "non-voting", "preferred", "ordinary")),
        ("word", "Business", ("company", "corporation", "parent", "entity")),
        ("word", "Individual", ("individual", "person", "natural person", "proprietor")),
    ),
    "psc_beneficiary_type": (
        (
            "exact",
            CATCH_ALL,
            ("guardian", "parent", "legal guardian", "next of kin", "custodian", "members", "professional", "consultant", "advisor"),
        ),
        ("exact", "Root Business", ("company", "corporation", "legal entity", "corporate entity")),
        ("word", "Root Business", ("corporate body", "body corporate", "parent structure", "business entity", "parent entity", "immediate parent", "ultimate parent", "global parent", "holding company", "parent company", "root entity")),
        # People with a part in a company, and companies that own, are not records of the company itself.
        ("word", "Controller", ("company secretary", "corporate secretary", "company director", "corporate director", "company officer", "corporate officer")),
        ("word", "Owner / Beneficial Owner", ("corporate beneficial owner", "corporate owner", "company owner", "corporate shareholder", "company shareholder")),
        ("word", "Root Business", ("company", "corporation", "legal entity", "corporate entity")),
        ("exact", "Controller", ("managing partner", "managing director")),
        ("exact", "Owner / Beneficial Owner", ("psc (person with significant control)",)),
        # A person with significant control or the like where the control itself is spoken of.
        ("pattern", "Controller", (r"(^|[^a-z0-9])(psc|isc)([^a-z0-9]|$).*control", r"(^|[^a-z0-9])(control|controlling) (psc|isc)([^a-z0-9]|$)")),
        (
            "word",
            "Owner / Beneficial Owner",
            (
                "beneficial owner", "ubo", "person with significant control", "psc", "indirect owner", "controlling person", "beneficiary", "owner", "proprietor", "co-owner", "principal",
                "shareholder", "partner", "bo",
            ),
        ),
        (
            "word",
            "Controller",
            (
                "authorized representative", "authorized signatory", "signatory", "power of attorney", "procurator", "agent", "confidential clerk", "attorney of record", "officer",
                "director", "administrator", "manager", "managing director", "chief executive", "board member", "secretary", "treasurer", "controller", "governor", "isc",
            ),
        ),
    ),
    "brn_type": (
        ("within", CATCH_ALL, ("registered on this transaction date", "gst/hst number is not valid", "combination not valid")),
        ("exact", CATCH_ALL, ("unknown", "unknown program number", "swift bic code", "cage", "commercial and government entity code")),
        ("exact", "LEI", ("lei", "legal entity identifier")),
        ("exact", "VAT Number", ("fra vat number", "gb vat number", "gst / hst account number", "gst/hst account number")),
        # On purpose wider than the seven countries that the rules list: any country's VAT number.
        ("pattern", "VAT Number", (r"^value added tax number( \([a-z]{2}\))?$",)),
        (
            "exact",
            "Charity Number",
            (
                "gbr charity no", "charity commission for england & wales charity number (gb)", "charity commission of northern ireland charity number (gb)",
                "office of scottish charity regulator charity number (gb)", "france national associations register identifier", "rna registration number",
            ),
        ),
        (
            "exact",
            "Proprietary / Third-party ID",
            ("sesamm company id", "xxx acuris id", "xxx edi global issuer id", "can techsalerator id", "can data axle hash", "usa corpwatch id", "usa cusip number", "validatis number"),
        ),
        (
            "exact",
            "Tax ID Number",
            (
                "tax id number", "input tax id", "tax id number - bn9", "cra business number", "cra business number incorporated in ns", "cra business number incorporated in bc",
                "cra business number incorporated in sk", "cra business number, incorporated in ns", "cra business number, incorporated in bc", "cra business number, incorporated in sk", "corporate income tax account number", "federal business number", "canadian business number",
                "can business number", "federal corporation number", "business identification number (bin)", "provincial business number", "mx rfc company", "cm nui tax reg num",
                "arg partial cuit", "esp nif", "fiscal code (it)", "general record of taxpayers (br)", "cnpj", "cnpj basic", "cnpj number", "cnpj number - establishment", "bra cnpj",
                "municipal registry number (br)", "state registry number (br)", "state registration number",
            ),
        ),
        (
            "exact",
            "Business Registration Number",
            (
                "uk company number", "acn", "abn", "ontario corporation number", "alberta corporation number", "dnk cvr", "deu registernummer", "nor org no", "nld kvk number",
                "esp borme reg id", "fra siren", "siren", "siret", "sgp unique entity number", "bel enterprise number", "bel establishment number", "can bc registration number",
                "can nl corporate registry", "can mb registry", "can ns corporate registry", "saskatchewan registry number", "quebec enterprise number", "on business id number",
                "us general services administration unique entity identifier", "usa sam uei number", "usa sec cik number", "usa fei number", "usa fl document no", "usa ga business id",
                "usa ga control no", "usa epa facility registry system", "usa frs id", "usa ny dos id", "usa vt biz id", "branch unit number", "nld kvk branch number",
                "register of business enterprises number - branch", "chamber of commerce number", "trade register number", "economic operator code",
                "legal entity and partnership information number", "rid", "ridet", "neq number", "register number", "derived unique register number", "registered company number",
                "business registration number", "business registration number - branch", "business registration number - head office", "business registration number - home jurisdiction",
                "registration number", "companies registry office number", "financial conduct authority reference number", "foreign business registration number",
            ),
        ),
    ),
    "business_legal_form": (
        ("exact", CATCH_ALL, ("[blank]", "unknown", "n/a", "information not available", "miscellaneous", "business name")),
        (
            "exact",
            "Partnership",
            (
                "general partnership", "limited partnership", "limited liability partnership", "llp", "lp", "l.p.", "vof", "snc", "joint venture company", "joint venture partnership",
                "co-venture", "ohg", "kg", "société en nom collectif",
            ),
        ),
        ("exact", "Foreign Entity / Branch", ("overseas company", "foreign company", "foreign company (rcs)", "extraprovincial company", "non-resident company", "alien corporation")),
        (
            "word",
            "Company",
            (
                "llc", "gmbh", "ltd", "plc", "s.a.", "ag", "bv", "nv", "pty ltd", "pty", "proprietary company", "proprietary limited", "sarl", "sas", "spa", "sociedad limitada",
                "corp", "inc", "incorporated", "s.a.p.i.", "s.a.s.", "holding", "holdco", "parent company", "group holding", "private limited", "private unlimited", "unlimited company",
                "ulc", "joint stock company", "independent company", "limited company", "company limited",
            ),
        ),
        (
            "word",
            "Partnership",
            ("partnership", "llp", "lp", "l.p.", "vof", "snc", "joint venture", "co-venture", "ohg", "kg", "société en nom collectif"),
        ),
        # Behind partnerships, as their names hold "limited" too.
        ("word", "Company", ("limited", "corporation")),
        (
            "word",
            "Sole Proprietorship / Individual Business",
            ("sole trader", "individual", "proprietorship", "trader", "craftsman", "enkeltpersonforetak", "enk", "entrepreneur individuel", "auto-entrepreneur", "gewerbetreibender"),
        ),
        (
            "word",
            "Non-Profit / Cooperative",
            ("nonprofit", "npo", "association", "union", "foundation", "cooperative", "co-op", "asbl", "association loi 1901", "coöperatie", "credit union", "stichting", "verein"),
        ),
        ("word", "Trust / Fund / Scheme", ("trust", "unit trust", "discretionary trust", "managed investment scheme", "fund", "scheme")),
        (
            "word",
            "Foreign Entity / Branch",
            (
                "branch", "establishment", "overseas company", "foreign company", "nuf", "extraprovincial company", "non-resident company", "external entity", "alien corporation",
                "subsidiary", "division", "sub",
            ),
        ),
        (
            "word",
            "Government / Public Sector Entity",
            ("government", "municipality", "commune", "kommune", "public authority", "public establishment", "ministry", "statutory body", "state-owned entity"),
        ),
        ("exact", "Company", ("company",)),
    ),
}

# Board and management titles by country. A country is given by any of its names. More
# countries can be given as a parameter of the same form.
REGIONAL: dict[tuple[str, ...], tuple[tuple[str, ...], tuple[str, ...]]] = {
    ("at", "austria"): (
        ("aufsichtsrat", "vorstand", "vorsitzender"),
        ("geschäftsführer", "prokurist", "betriebsleiter", "abteilungsleiter"),
    ),
    ("be", "belgium"): (
        ("bestuurder", "administrateur", "lid van de raad van bestuur", "voorzitter van de raad"),
        ("directeur", "bedrijfsleider", "zaakvoerder", "gedelegeerd bestuurder"),
    ),
    ("bg", "bulgaria"): (
        ("съвет на директорите", "надзорен съвет", "член на съвета"),
        ("изпълнителен директор", "управител", "ръководител"),
    ),
    ("ch", "switzerland"): (
        ("verwaltungsrat", "administrateur", "membro del consiglio d'amministrazione", "präsident des verwaltungsrats"),
        ("geschäftsführer", "directeur", "direttore", "betriebsleiter"),
    ),
    ("cy", "cyprus"): (
        ("διοικητικός σύμβουλος", "μέλος διοικητικού συμβουλίου", "πρόεδρος διοικητικού συμβουλίου"),
        ("διευθυντής", "προϊστάμενος", "γενικός διευθυντής"),
    ),
    ("cz", "czechia", "czech republic"): (
        ("dozorčí rada", "představenstvo", "předseda představenstva"),
        ("jednatel", "ředitel", "vedoucí"),
    ),
    ("de", "germany"): (
        ("vorstand", "aufsichtsrat", "beirat", "vorstandsmitglied", "aufsichtsratsmitglied"),
        ("prokurist", "geschäftsführer", "betriebsleiter", "abteilungsleiter"),
    ),
    ("dk", "denmark"): (
        ("bestyrelsesmedlem", "bestyrelsesformand", "medlem af bestyrelsen"),
        ("direktør", "daglig leder", "afdelingsleder"),
    ),
    ("ee", "estonia"): (
        ("nõukogu liige", "juhatuse liige", "nõukogu esimees"),
        ("direktor", "juhataja", "osakonnajuhataja"),
    ),
    ("es", "spain"): (
        ("consejero", "vocal", "administrador solidario", "presidente del consejo", "administrador único"),
        ("director de departamento", "gerente", "director general"),
    ),
    ("fi", "finland"): (
        ("hallituksen jäsen", "puheenjohtaja", "hallituksen puheenjohtaja"),
        ("toimitusjohtaja", "päällikkö", "johtaja"),
    ),
    ("fr", "france"): (
        ("administrateur", "président du conseil d'administration", "membre du directoire", "président (sas)", "président du conseil de surveillance"),
        ("directeur général", "directeur opérationnel", "directeur de département"),
    ),
    ("gi", "gibraltar"): (
        ("non-executive director", "board director", "chairman", "managing director", "ceo", "chief executive officer"),
        ("manager", "department head", "operations manager"),
    ),
    ("gr", "greece"): (
        ("μέλος διοικητικού συμβουλίου", "πρόεδρος δς", "αντιπρόεδρος δς", "δς"),
        ("διευθυντής", "τμηματάρχης", "γενικός διευθυντής"),
    ),
    ("hr", "croatia"): (
        ("nadzorni odbor", "upravno vijeće", "predsjednik nadzornog odbora"),
        ("direktor", "upravitelj", "voditelj", "poslovodja"),
    ),
    ("hu", "hungary"): (
        ("igazgatósági tag", "felügyelőbizottság", "elnök", "igazgatóság"),
        ("igazgató", "osztályvezető", "vezető"),
    ),
    ("ie", "ireland"): (
        ("non-executive director", "(ned)", "managing director", "ceo", "chief executive officer", "chairperson", "executive director"),
        ("general manager", "operations manager", "secretary", "department manager"),
    ),
    ("is", "iceland"): (
        ("stjórnarmaður", "stjórnarformaður", "meðstjórnandi"),
        ("framkvæmdastjóri", "deildarstjóri"),
    ),
    ("it", "italy"): (
        ("consigliere", "amministratore delegato", "presidente del consiglio", "membro del consiglio di amministrazione"),
        ("dirigente", "responsabile", "direttore generale"),
    ),
    ("li", "liechtenstein"): (
        ("verwaltungsrat", "stiftungsrat", "verwaltungsratsmitglied"),
        ("geschäftsführer", "leiter", "prokurist"),
    ),
    ("lt", "lithuania"): (
        ("valdybos narys", "stebėtojų taryba", "valdybos pirmininkas"),
        ("direktorius", "vadovas", "skyriaus vadovas"),
    ),
    ("lu", "luxembourg"): (
        ("administrateur", "membre du conseil d'administration", "président du conseil"),
        ("directeur", "gérant", "responsable"),
    ),
    ("lv", "latvia"): (
        ("padomes loceklis", "valdes loceklis", "padomes priekšsēdētājs"),
        ("direktors", "vadītājs", "nodaļas vadītājs"),
    ),
    ("mc", "monaco"): (
        ("administrateur", "président du conseil d'administration", "membre du conseil"),
        ("directeur général", "gérant", "directeur"),
    ),
    ("mt", "malta"): (
        ("direttur mhux eżekuttiv", "(ned)", "membru tal-bord", "chairperson", "non-executive director", "managing director", "ceo", "chief executive officer"),
        ("maniġer", "direttur maniġerjali", "secretary", "kap"),
    ),
    ("nl", "netherlands"): (
        ("bestuurder", "commissaris", "lid van de raad van commissarissen", "voorzitter van de raad"),
        ("directeur", "manager", "algemeen directeur"),
    ),
    ("no", "norway"): (
        ("styremedlem", "styreleder", "nestleder"),
        ("daglig leder", "direktør", "avdelingsleder"),
    ),
    ("pl", "poland"): (
        ("członek zarządu", "rada nadzorcza", "prezes zarządu", "wiceprezes zarządu"),
        ("dyrektor", "kierownik", "kierownik działu"),
    ),
    ("pt", "portugal"): (
        ("administrador", "membro do conselho de administração", "presidente do conselho"),
        ("diretor-geral", "gerente", "diretor de departamento"),
    ),
    ("ro", "romania"): (
        ("membru al consiliului de administrație", "consiliului de administrație", "cenzor", "președinte al consiliului"),
        ("director general", "manager", "administrator delegat", "șef de departament"),
    ),
    ("se", "sweden"): (
        ("styrelseledamot", "styrelseordförande", "suppleant", "styrelsens ordförande"),
        ("verkställande direktör", "(vd)", "enhetschef", "avdelningschef"),
    ),
    ("si", "slovenia"): (
        ("nadzorni svet", "upravni odbor", "predsednik nadzornega sveta"),
        ("direktor", "poslovodja", "vodja oddelka"),
    ),
    ("sk", "slovakia"): (
        ("dozorná rada", "predstavenstvo", "predseda predstavenstva"),
        ("konateľ", "riaditeľ", "vedúci"),
    ),
    ("uk", "gb", "united kingdom"): (
        ("non-executive director", "(ned)", "managing director", "chief executive officer", "ceo", "chairman of the board", "executive director"),
        ("general manager", "operations director", "department manager"),
    ),
}

# Titles that a country's notes call executive management outright.
EXECUTIVE: dict[tuple[str, ...], tuple[str, ...]] = {
    ("be", "belgium"): ("zaakvoerder",),
    ("bg", "bulgaria"): ("управител",),
    ("ch", "switzerland"): ("geschäftsführer",),
    ("cz", "czechia", "czech republic"): ("jednatel",),
    ("de", "germany"): ("geschäftsführer",),
    ("dk", "denmark"): ("direktør",),
    ("es", "spain"): ("director general",),
    ("fi", "finland"): ("toimitusjohtaja",),
    ("fr", "france"): ("directeur général",),
    ("gr", "greece"): ("γενικός διευθυντής",),
    ("hr", "croatia"): ("direktor", "poslovodja"),
    ("hu", "hungary"): ("igazgató",),
    ("is", "iceland"): ("framkvæmdastjóri",),
    ("it", "italy"): ("direttore generale",),
    ("lt", "lithuania"): ("direktorius",),
    ("lu", "luxembourg"): ("gérant",),
    ("nl", "netherlands"): ("algemeen directeur",),
    ("no", "norway"): ("daglig leder",),
    ("ro", "romania"): ("administrator",),
    ("se", "sweden"): ("verkställande direktör", "(vd)"),
    ("si", "slovenia"): ("poslovodja",),
    ("sk", "slovakia"): ("konateľ",),
    ("uk", "gb", "united kingdom"): ("general manager", "operations director"),
}

COMPLIANCE = r"liquidator|receiver|insolvency practitioner"


def _fits(text: Column, kind: str, phrases: tuple[str, ...]) -> Column:
    quoted = [re.escape(p).replace(r"\ ", " ") for p in phrases]
    if kind == "exact":
        return text.isin(*phrases)
    if kind == "prefix":
        return text.rlike("^(" + "|".join(quoted) + ")")
    if kind == "word":
        return text.rlike("(?<![a-z0-9])(" + "|".join(quoted) + ")(?![a-z0-9])")
    if kind == "within":
        return text.rlike("|".join(quoted))
    return text.rlike("|".join(phrases))


def label_by_rules(field_key: str, raw: Column, rules: dict[str, tuple[Rule, ...]] = RULES) -> Column:
    """The label of a value by its field's rules, the catch-all if none fits."""
    text, label = F.lower(raw), F.lit(CATCH_ALL)
    for kind, name, phrases in reversed(rules[field_key]):
        label = F.when(_fits(text, kind, phrases), name).otherwise(label)
    return label


def one_sigma(text: str) -> str:
    """A final sigma as any other: engines differ in what they make of a capital one."""
    return text.replace("ς", "σ")


def _any_word(titles: tuple[str, ...]) -> str:
    return "(?<![a-z0-9])(" + "|".join(re.escape(one_sigma(t)).replace(r"\ ", " ") for t in titles) + ")(?![a-z0-9])"


def position_by_region(raw: Column, country: Column, general: Column, regional: dict = REGIONAL, executive: dict = EXECUTIVE) -> Column:
    """A title's label by its country's tables, else ``general``.

    Board titles come first, then those that the country's notes call executive management. Any
    other title of the management list is never a board member or director: where ``general`` says
    so, it is executive management. A map gives each country its patterns, so the expression has the
    same size for any number of countries; ask it for distinct titles.
    """
    text, place = F.translate(F.lower(raw), "ς", "σ"), F.lower(country)

    def fits(titles: dict[tuple[str, ...], tuple[str, ...]]) -> Column:
        patterns = [F.lit(x) for names, own in titles.items() if own for name in names for x in (name, _any_word(own))]
        return F.regexp_like(text, F.try_element_at(F.create_map(*patterns), place)) if patterns else F.lit(False)

    board, management = ({names: lists[i] for names, lists in regional.items()} for i in (0, 1))
    demoted = fits(management) & general.isin("Board Member", "Director")
    return F.when(fits(board), "Board Member").when(fits(executive) | demoted, "Executive Management").otherwise(general)


def governor(raw: Column, legal_form: Column, otherwise: Column) -> Column:
    """A governor is a director of a corporation, but an owner of an LLC or LLP."""
    owner = F.lower(legal_form).rlike(r"(?<![a-z0-9])(llc|llp)(?![a-z0-9])")
    return F.when(F.lower(raw).rlike(r"(?<![a-z0-9])governor(?![a-z0-9])"), F.when(owner, "Owner / Controller").otherwise("Director")).otherwise(otherwise)


def compliance_flag(raw: Column) -> Column:
    """Whether a title says that a company is being wound up."""
    return F.lower(raw).rlike(COMPLIANCE)


def rules_column(field_key: Column, raw: Column, country: Column, rules: dict[str, tuple[Rule, ...]] = RULES) -> Column:
    """The written rules for ``standardize.by_column``: HIGH if a rule fits and else LOW."""
    std = F.lit(CATCH_ALL)
    for key in rules:
        std = F.when(field_key == key, label_by_rules(key, raw, rules)).otherwise(std)
    sure = std != CATCH_ALL
    return F.struct(
        std.alias("std"), F.when(sure, "HIGH").otherwise("LOW").alias("confidence"), F.array().cast("array<string>").alias("alternatives"), F.when(sure, "").otherwise("No written rule fits").alias("reasoning")
    )
