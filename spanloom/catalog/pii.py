"""Rules for personal data: generic, US, UK, EU and Asia-Pacific, in the order in which they are tried."""

from __future__ import annotations

from spanloom.catalog.model import Rule

# Expressions, context words, scores and confidences of each rule.
_ROWS = (
    ("generic", "CREDIT_CARD", "luhn", 0.3, "medium", False, ("credit", "card", "visa", "mastercard", "cc", "amex", "discover", "jcb", "diners", "maestro", "instapayment"),
     r"\b(?!1\d{12}(?!\d))((4\d{3})|(5[0-5]\d{2})|(6\d{3})|(1\d{3})|(3\d{3}))[- ]?(\d{3,4})[- ]?(\d{3,4})[- ]?(\d{3,5})\b"),
    ("generic", "EMAIL_ADDRESS", None, 0.5, "medium", False, ("email", "e-mail", "mail"),
     r"\b(?:[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~](?:[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~.]{0,62}[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~])?)@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}\b"),
    ("generic", "IBAN_CODE", "iban", 0.5, "medium", False, ("iban", "bank", "transaction"),
     r"(?<![A-Z0-9])([A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,4})?)(?![A-Z0-9])"),
    ("generic", "IP_ADDRESS", None, 0.6, "medium", False, ("ip", "ipv4", "ipv6", "address"),
     r"\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
     r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", r"\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b", r"\b(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}\b"),
    ("generic", "MAC_ADDRESS", "mac", 0.6, "medium", False, ("mac", "mac address", "hardware address", "physical address", "ethernet"),
     r"\b[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}\b", r"\b[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\b"),
    ("generic", "PHONE_NUMBER", None, 0.4, "low", False, ("phone", "number", "telephone", "cell", "cellphone", "mobile", "call", "tel", "fax"),
     r"\b\+?1?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", r"\b\+\d{1,3}[\s.-]?\(?\d{1,4}\)?[\s.-]?\d{2,4}[\s.-]?\d{2,4}[\s.-]?\d{0,4}\b"),
    ("generic", "URL", None, 0.6, "medium", True, ("url", "website", "link", "href"), r"\bhttps?:\/\/[^\s<>\"']+", r"\bwww\.[^\s<>\"']+"),
    ("generic", "CRYPTO", None, 0.5, "medium", False, ("wallet", "btc", "bitcoin", "crypto", "blockchain"), r"(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,59}"),
    ("generic", "DATE_TIME", None, 0.3, "low", False, ("date", "birthday", "born", "dob"),
     r"\b\d{4}-[01]\d-[0-3]\dT[0-2]\d:[0-5]\d:[0-5]\d(?:\.\d+)?(?:[+-][0-2]\d:[0-5]\d|Z)\b", r"\b(?:[0-3]?\d[/.-][0-3]?\d[/.-](?:\d{4}|\d{2}))\b", r"\b\d{4}[/.-](?:0?[1-9]|1[0-2])[/.-](?:0?[1-9]|[12]\d|3[01])\b"),
    ("us", "US_SSN", "ssn", 0.5, "medium", False, ("social", "security", "ssn", "ssns", "ssid"), r"\b(\d{3})[- .](\d{2})[- .](\d{4})\b"),
    ("us", "US_SSN", "ssn", 0.15, "low", False, ("social", "security", "ssn", "ssns", "ssid"), r"\b\d{9}\b"),
    ("us", "US_DRIVER_LICENSE", None, 0.3, "low", False, ("driver", "license", "permit", "lic", "identification", "dls", "cdls", "driving"),
     r"\b(?:[A-Z]\d{3,6}|[A-Z]\d{5,9}|[A-Z]\d{6,8}|[A-Z]\d{4,8}|[A-Z]\d{9,11}|[A-Z]{1,2}\d{5,6}|H\d{8}|V\d{6}|X\d{8}|[A-Z]{2}\d{2,5}|[A-Z]{2}\d{3,7}|\d{2}[A-Z]{3}\d{5,6}|[A-Z]\d{13,14}|[A-Z]\d{18}|[A-Z]\d{6}R|[A-Z]\d{9}|[A-Z]\d{1,12}|\d{9}[A-Z]|[A-Z]{2}\d{6}[A-Z]|\d{8}[A-Z]{2}|\d{3}[A-Z]{2}\d{4}|[A-Z]\d[A-Z]\d[A-Z]|\d{7,8}[A-Z])\b"),
    ("us", "US_PASSPORT", None, 0.1, "low", False, ("us", "united", "states", "passport", "travel", "document"), r"\b[A-Z]\d{8}\b", r"\b\d{9}\b"),
    ("us", "US_BANK_NUMBER", None, 0.05, "low", False, ("check", "account", "acct", "bank", "save", "debit", "routing"), r"\b\d{8,17}\b"),
    ("us", "US_ITIN", None, 0.5, "medium", False, ("individual", "taxpayer", "itin", "tax", "payer", "taxid", "tin"),
     r"\b9\d{2}[- ](5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])[- ]\d{4}\b", r"\b9\d{2}(5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])\d{4}\b"),
    ("us", "US_MBI", None, 0.5, "medium", False, ("medicare", "mbi", "beneficiary", "cms", "medicaid", "hic", "hicn"),
     r"\b[0-9][ACDEFGHJKMNPQRTUVWXY][0-9ACDEFGHJKMNPQRTUVWXY][0-9][ACDEFGHJKMNPQRTUVWXY][0-9ACDEFGHJKMNPQRTUVWXY][0-9][ACDEFGHJKMNPQRTUVWXY]{2}[0-9]{2}\b",
     r"\b[0-9][ACDEFGHJKMNPQRTUVWXY][0-9ACDEFGHJKMNPQRTUVWXY][0-9]-[ACDEFGHJKMNPQRTUVWXY][0-9ACDEFGHJKMNPQRTUVWXY][0-9]-[ACDEFGHJKMNPQRTUVWXY]{2}[0-9]{2}\b"),
    ("us", "US_NPI", "npi", 0.1, "low", False, ("npi", "national provider", "provider", "provider id", "provider identifier", "taxonomy"), r"\b[12]\d{3}[ -]\d{3}[ -]\d{3}\b", r"\b[12]\d{9}\b"),
    ("us", "ABA_ROUTING_NUMBER", "aba", 0.05, "low", False, ("aba", "routing", "abarouting", "association", "bankrouting"), r"\b[0123678]\d{3}-\d{4}-\d\b", r"\b[0123678]\d{8}\b"),
    ("us", "MEDICAL_LICENSE", "dea", 0.4, "low", False, ("medical", "certificate", "DEA", "dea"), r"[abcdefghjklmprstuxABCDEFGHJKLMPRSTUX][a-zA-Z]\d{7}", r"[abcdefghjklmprstuxABCDEFGHJKLMPRSTUX]9\d{7}"),
    ("uk", "UK_NHS", "nhs", 0.5, "medium", False, ("national health service", "nhs", "health services authority", "health authority"), r"\b(\d{3})[- ]?(\d{3})[- ]?(\d{4})\b"),
    ("uk", "UK_NINO", None, 0.5, "medium", True, ("national insurance", "ni number", "nino"), r"\b(?!BG|GB|NK|KN|NT|TN|ZZ)(?:[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z])\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b"),
    ("uk", "UK_PASSPORT", None, 0.1, "low", False, ("passport", "passport number", "travel document", "uk passport", "british passport", "her majesty", "his majesty", "hm passport", "hmpo"), r"\b[A-Z]{2}\d{7}\b"),
    ("uk", "UK_POSTCODE", None, 0.1, "low", False, ("postcode", "post code", "postal code", "zip", "address", "delivery", "mailing", "shipping"),
     r"\b(?:GIR\s?0AA|[A-PR-UWYZ]\d[A-HJKPSTUW]?\s?\d[ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ]\d{2}\s?\d[ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ][A-HK-Y]\d[ABEHMNPRVWXY]?\s?\d[ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ][A-HK-Y]\d{2}\s?\d[ABD-HJLNP-UW-Z]{2})\b"),
    ("uk", "UK_VEHICLE_REGISTRATION", None, 0.2, "low", False, ("vehicle", "registration", "number plate", "licence plate", "license plate", "reg", "vrn", "dvla", "v5c", "mot", "car"),
     r"\b[A-HJ-PR-Y]{2}(?:0[1-9]|[1-7]\d)[- ]?[A-HJ-PR-Z]{3}\b", r"\b[A-HJ-NPR-TV-Y]\d{1,3}[- ]?[A-HJ-PR-Y][A-HJ-PR-Z]{2}\b", r"\b[A-HJ-PR-Z]{3}[- ]?\d{1,3}[- ]?[A-HJ-NPR-TV-Y]\b"),
    ("eu", "ES_NIF", "nif", 0.5, "medium", False, ("documento nacional de identidad", "dni", "nif", "identificación"), r"\b\d{7,8}[-]?[A-Z]\b"),
    ("eu", "ES_NIE", "nie", 0.5, "medium", False, ("número de identificación de extranjero", "nie"), r"\b[XYZ]\d{7}[-]?[A-Z]\b"),
    ("eu", "IT_FISCAL_CODE", "fiscal", 0.3, "medium", True, ("codice fiscale", "cf"),
     r"(?:[A-Z][AEIOU][AEIOUX]|[AEIOU]X{2}|[B-DF-HJ-NP-TV-Z]{2}[A-Z]){2}(?:[\dLMNP-V]{2}(?:[A-EHLMPR-T](?:[04LQ][1-9MNP-V]|[15MR][\dLMNP-V]|[26NS][0-8LMNP-U])|[DHPS][37PT][0L]|[ACELMRT][37PT][01LM]|[AC-EHLMPR-T][26NS][9V])|(?:[02468LNQSU][048LQU]|[13579MPRTV][26NS])B[26NS][9V])(?:[A-MZ][1-9MNP-V][\dLMNP-V]{2}|[A-M][0L](?:[1-9MNP-V][\dLMNP-V]|[0L][1-9MNP-V]))[A-Z]"),
    ("eu", "IT_DRIVER_LICENSE", None, 0.2, "low", True, ("patente", "patente di guida", "licenza", "licenza di guida"), r"\b(?:[A-Z]{2}\d{7}[A-Z]|U1[BCDEFGHLJKMNPRSTUWYXZ0-9]{7}[A-Z])\b"),
    ("eu", "IT_VAT_CODE", "vat", 0.1, "low", False, ("piva", "partita iva", "pi"), r"\b\d{11}\b"),
    ("eu", "IT_PASSPORT", None, 0.01, "low", True, ("passaporto", "elettronico", "italiano", "viaggio", "documento"), r"\b[A-Z]{2}\d{7}\b"),
    ("eu", "IT_IDENTITY_CARD", None, 0.01, "low", True, ("carta", "identità", "elettronica", "cie", "documento"), r"\b[A-Z]{2}\s?\d{7}\b", r"\b\d{7}[A-Z]{2}\b", r"\b[A-Z]{2}\d{5}[A-Z]{2}\b"),
    ("eu", "PL_PESEL", "pesel", 0.4, "medium", False, ("pesel",), r"\b\d{2}(?:[02468][1-9]|[13579][012])(?:0[1-9]|[12]\d|3[01])\d{5}\b"),
    ("eu", "FI_PERSONAL_IDENTITY_CODE", "hetu", 0.5, "medium", False, ("hetu", "henkilötunnus", "personal identity code"), r"\b(\d{6})([+\-ABCDEFYXWVU])(\d{3})([0-9ABCDEFHJKLMNPRSTUVWXY])\b"),
    ("eu", "SE_PERSONNUMMER", "personnummer", 0.5, "medium", False, ("personnummer", "svenskt personnummer", "svensk id", "personal identity number", "samordningsnummer"), r"\b(\d{6,8})([-+]?)\d{4}\b"),
    ("eu", "DE_TAX_ID", "steuer", 0.5, "medium", False, ("steueridentifikationsnummer", "steuer-id", "steuerid", "idnr", "steuer-idnr", "steuernummer"), r"\b[1-9]\d{10}\b"),
    ("eu", "DE_PASSPORT", None, 0.4, "low", False, ("personalausweis", "ausweis", "reisepass", "pass", "dokumentennummer", "seriennummer"), r"\b[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7}[CFGHJKLMNPRTVWXYZ0-9]\b", r"\bT\d{8}\b"),
    ("apac", "SG_NRIC_FIN", None, 0.5, "medium", True, ("fin", "nric"), r"\b[STFGM]\d{7}[A-Z]\b"),
    ("apac", "SG_UEN", None, 0.3, "low", False, ("uen", "unique entity number", "business registration", "acra"), r"\b\d{8}[A-Z]\b", r"\b\d{9}[A-Z]\b", r"\b[TS]\d{2}[A-Z]{2}\d{4}[A-Z]\b"),
    ("apac", "AU_ABN", "abn", 0.1, "low", False, ("australian business number", "abn"), r"\b\d{2}\s\d{3}\s\d{3}\s\d{3}\b", r"\b\d{11}\b"),
    ("apac", "AU_ACN", "acn", 0.1, "low", False, ("australian company number", "acn"), r"\b\d{3}\s\d{3}\s\d{3}\b", r"\b\d{9}\b"),
    ("apac", "AU_TFN", "tfn", 0.1, "low", False, ("tax file number", "tfn"), r"\b\d{3}\s\d{3}\s\d{3}\b", r"\b\d{9}\b"),
    ("apac", "AU_MEDICARE", "au_medicare", 0.1, "low", False, ("medicare",), r"\b[2-6]\d{3}\s\d{5}\s\d\b", r"\b[2-6]\d{9}\b"),
    ("apac", "IN_PAN", None, 0.5, "medium", True, ("permanent account number", "pan"), r"\b[A-Z]{3}[ABCFGHHJLPT][A-Z]\d{4}[A-Z]\b", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("apac", "IN_AADHAAR", "aadhaar", 0.01, "low", False, ("aadhaar", "uidai"), r"\b\d{4}[- :]\d{4}[- :]\d{4}\b", r"\b\d{12}\b"),
    ("apac", "IN_VEHICLE_REGISTRATION", None, 0.5, "medium", False, ("rto", "vehicle", "plate", "registration"), r"\b[A-Z]{2}\d{2}[A-Z]{1,2}\d{4}\b", r"\b[A-Z]{2}\d[A-Z]{1,3}\d{4}\b"),
    ("apac", "IN_VOTER", None, 0.3, "low", True, ("voter", "epic", "elector photo identity card"), r"\b[A-Z]{3}\d{7}\b"),
    ("apac", "IN_PASSPORT", None, 0.1, "low", False, ("passport", "indian passport", "passport number"), r"\b[A-Z][1-9]\d\s?\d{4}[1-9]\b"),
    ("apac", "KR_RRN", "rrn", 0.5, "medium", False, ("resident registration number", "rrn", "korean rrn"), r"(?<!\d)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])-?[1-4]\d{6}(?!\d)"),
    ("apac", "KR_PASSPORT", None, 0.1, "low", True, ("passport", "korean passport", "여권"), r"(?<![A-Z0-9])[MSROD]\d{3}[A-Z]\d{4}(?!\d)", r"(?<![A-Z0-9])[MSROD]\d{8}(?!\d)"),
    ("apac", "TH_TNIN", "tnin", 0.5, "medium", False, ("thai national id", "thai id number", "tnin"), r"\b[1-9](?:[134]\d|[25][0134567]|[67][01234567]|[89][0123456])\d{10}\b"),
    ("apac", "NG_NIN", "nin", 0.01, "low", False, ("nin", "national identification number", "national identity number", "nimc"), r"\b\d{11}\b"),
)

RULES = tuple(Rule(kind, tuple(patterns), family, score, confidence, validator, words, ignore_case) for family, kind, validator, score, confidence, ignore_case, words, *patterns in _ROWS)
