"""Entity names, patterns, word lists, labels and formats that results depend on.

They are the published vocabulary of the operators and are listed as they are; everything
else in the library is derived from them.
"""

from __future__ import annotations

LEVELS = ("standard", "strict")
STYLES = ("black", "blur", "placeholder")
RESPONSES = ("file", "json", "full")
ENTITIES = ("PERSON_NAME", "DNI_NIE", "EMAIL", "PHONE", "IBAN", "ADDRESS", "DATE_OF_BIRTH", "FACE", "SIGNATURE", "SENSITIVE_DATA")

# Recognizer entity -> finding type.
ENTITY_MAP = {
    "PERSON": "PERSON_NAME",
    "ES_NIF": "DNI_NIE",
    "ES_NIE": "DNI_NIE",
    "EMAIL_ADDRESS": "EMAIL",
    "PHONE_NUMBER": "PHONE",
    "IBAN_CODE": "IBAN",
    "ES_ADDRESS": "ADDRESS",
    "ES_DATE_OF_BIRTH": "DATE_OF_BIRTH",
}
STANDARD = ("PERSON", "ES_NIF", "ES_NIE", "EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "ES_DATE_OF_BIRTH")
STRICT = (*STANDARD, "ES_ADDRESS")

# Patterns, in the JVM's dialect: (?U) for Unicode classes and boundaries.
PHONE_INTL = r"(?U)\+34[\s.\-]?[69]\d{2}[\s.\-]?\d{3}[\s.\-]?\d{3}"
PHONE_LOCAL = r"(?U)\b[69]\d{2}[\s.\-]?\d{3}[\s.\-]?\d{3}\b"
IBAN_FULL = r"(?iU)\bES\s?\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"
IBAN_LABELED = r"(?iU)(?:IBAN[:\s]*)\bES\s?\d{2}[\s\-]?[\d\s\-\*]{12,24}\b"
IBAN_MASKED = r"(?iU)\bES\s?\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?[\d\s\-]{2,10}[\d\*Xx]{2,8}\b"
IBAN_ANY = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
DATE = r"(?U)\b\d{1,2}[/\-\.\s]\d{1,2}[/\-\.\s]\d{2,4}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NIF = r"(?U)\b\d{7,8}-?[A-Z]\b"
NIE = r"(?U)\b[XYZ]-?\d{7}-?[A-Z]\b"
NAME_WORD = "[A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ]+"
PERSON_INVERTED = rf"(?U)\b{NAME_WORD}[^\S\n]+{NAME_WORD},[^\S\n]*{NAME_WORD}(?:[^\S\n]+{NAME_WORD})?\b"
NAME_LINES = r"([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑa-záéíóúñ\s]+)"
PERSON_STRUCTURED = rf"(?iU)(?:APELLIDOS?|PRIMER\s+APELLIDO)[:\s]*\n\s*{NAME_LINES}\n\s*NOMBRE[:\s]*\n\s*{NAME_LINES}"
STREETS = r"(?:c(?:alle|/)|c\.|av(?:da)?\.?|avenida|plaza|p(?:za?)?\.?|paseo|pº|camino|ronda|traves[ií]a|carrera|urbanizaci[oó]n|urb\.?|partida|barrio|pol[ií]gono|glorieta|bulevar|blvd\.?)"
CITY = r"[a-záéíóúñ][a-záéíóúñ\s]+(?:\([a-záéíóúñ][a-záéíóúñ\s]+\))?"
ADDRESS_FULL = rf"(?iU){STREETS}\s+.{{3,50}}?,?\s*\d{{1,4}}(?:\s*[-,]\s*(?:planta\s*)?\d{{1,3}}[ºª]?\s*[a-z]?)?(?:\s*,?\s*\d{{5}}\s*[-–]?)?(?:\s*,?\s*{CITY})?"
POSTAL_CITY = rf"(?iU)\b\d{{5}}\s*[-–]?\s*{CITY}"

# Words that raise a score when they stand shortly before a match.
CONTEXT = {
    "PHONE_NUMBER": ("teléfono", "telefono", "móvil", "movil", "llamar", "contacto", "tel", "tfno", "telf", "número", "numero"),
    "IBAN_CODE": ("iban", "cuenta", "bancaria", "banco", "transferencia", "domiciliación", "domiciliacion", "cuenta corriente", "nº cuenta"),
    "PERSON": ("tomador", "asegurado", "beneficiario", "titular", "nombre", "sr", "sra", "don", "doña", "d.", "dña", "firmante", "representante", "colaborador", "mediador", "contratante"),
    "ES_ADDRESS": ("dirección", "direccion", "domicilio", "residencia", "domiciliado", "domiciliada", "sita en", "con domicilio", "c.p.", "código postal", "cp", "vive en", "sito en", "ubicado", "ubicación", "ubicacion"),
    "ES_DATE_OF_BIRTH": ("nacimiento", "fecha nacimiento", "f. nac", "nacido", "nacida", "fecha de nacimiento", "born", "f.nac", "fec. nacimiento", "fec nacimiento"),
}

PERSON_LABELS = ("apellido", "apellidos", "nombre", "primer", "segundo")
PERSON_DENIED = (
    "condiciones", "generales", "particulares", "seguro", "seguros", "mutua", "aseguradora", "póliza", "tomador", "mediador", "beneficiario", "siniestro", "prima", "cobertura", "prestación", "indemnización", "franquicia", "suplemento", "anexo", "artículo", "reglamento", "legislación", "jurisdicción", "tribunal", "juzgado", "cláusula", "boletín",
    "volcánicas", "huracanes", "asegurados", "beneficiarios", "terceros", "daños", "perjuicios", "gastos", "riesgos", "coberturas", "exclusiones", "prestaciones", "obligaciones", "cláusulas", "garantías", "indemnizaciones", "primas", "reclamaciones", "siniestros", "erupciones",
    "además", "excepto", "siempre", "mientras", "aunque", "incluso", "mediante", "respecto",
    "recibo", "contrato", "vigencia", "importe", "plazo", "servicio", "objeto", "acuerdo", "ámbito", "alcance", "efecto", "supuesto", "contendrá",
    "cardenal", "gardoqui",
)
STOP_WORDS = (
    "de", "del", "la", "el", "los", "las", "en", "por", "con", "para", "que", "como", "salvo", "así", "sobre", "hasta", "según", "entre", "desde", "bajo", "ante", "sin", "tras", "al", "un", "una", "su",
    "sus", "se", "si", "no", "ya", "más", "muy", "cada", "todo", "toda", "otros", "otras", "este", "esta", "ese", "esa", "será", "debe", "puede", "sino", "donde", "cuando", "también", "otro", "otra",
)

# Zero-shot labels -> finding type; any other label is SENSITIVE_DATA.
LABELS = {
    "person": "PERSON_NAME",
    "email": "EMAIL",
    "phone number": "PHONE",
    "iban": "IBAN",
    "date of birth": "DATE_OF_BIRTH",
    "address": "ADDRESS",
    "passport number": "DNI_NIE",
    "social security number": "DNI_NIE",
    "credit card number": "SENSITIVE_DATA",
    "medical condition": "SENSITIVE_DATA",
    "medication": "SENSITIVE_DATA",
    "ip address": "SENSITIVE_DATA",
    "bank account": "SENSITIVE_DATA",
    "tax identification number": "SENSITIVE_DATA",
    "driver license": "SENSITIVE_DATA",
    "vehicle registration": "SENSITIVE_DATA",
}

NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
BLOCK = "█"

# MIME type -> (category, file extensions that name it).
FORMATS = {
    "application/pdf": ("pdf", ("pdf",)),
    "image/jpeg": ("image", ("jpg", "jpeg")),
    "image/png": ("image", ("png",)),
    "image/tiff": ("image", ("tif", "tiff")),
    "image/bmp": ("image", ("bmp",)),
    "image/webp": ("image", ("webp",)),
    "text/plain": ("text", ("txt",)),
    "text/markdown": ("text", ("md", "markdown")),
    "text/csv": ("spreadsheet", ("csv",)),
    "application/json": ("structured", ("json",)),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ("spreadsheet", ("xlsx",)),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ("document", ("docx",)),
    "text/html": ("structured", ("html", "htm")),
    "text/rtf": ("document", ()),
    "application/rtf": ("document", ("rtf",)),
    "application/vnd.oasis.opendocument.spreadsheet": ("spreadsheet", ("ods",)),
    "application/vnd.oasis.opendocument.text": ("document", ("odt",)),
}
