"""Word lists of the analyzer, German and English. Results depend on them. Stems match any ending."""

ACTION_STEMS_DE = ("schreib", "erstell", "generier", "übersetz", "fass", "summar", "analysier", "prüf", "erklär", "extrahier", "klassifizier", "konvertier", "plan", "kürz", "paraphras", "korrigier", "bewert", "entwirf", "verfass", "fertig", "list", "identifizier", "find", "gib", "nenn", "ermittel", "zeig", "überarbeit", "konzentrier")
ACTION_STEMS_EN = ("write", "create", "generate", "translate", "summarize", "summarise", "analy", "review", "check", "extract", "classify", "convert", "plan", "draft", "rewrite", "rename", "refactor", "tidy", "fill", "explain", "improve", "list", "identif", "find", "return", "enumerat", "collect", "select", "retriev", "show", "output")
ARTIFACT_NOUNS = ("liste", "list", "tabelle", "table", "bericht", "report", "email", "letter", "code", "script", "dict", "json", "csv", "markdown", "zusammenfassung", "summary", "outline", "rezept", "recipe", "haiku", "gedicht", "werbetext", "function", "bullet", "key", "keys")
OUTPUT_FORMAT_WORDS = ("json", "csv", "markdown", "yaml", "xml", "tabelle", "table", "liste", "list", "text", "format", "struktur", "schema")
GUIDELINE_HEADINGS = ("Regeln", "Rules", "Principles", "Scope", "Geltungsbereich", "Policy", "Policies", "Richtlinie", "Guidelines", "Conventions", "Vorgaben", "Anweisungen", "Leitlinie", "Prinzipien", "Leitfaden", "Leitfäden")
COMPOUND_HEADING_SUFFIXES = ("stil", "richtlinie", "policy", "guideline", "anleitung", "konvention", "regeln", "rules", "style", "kommunikation", "verhalten", "leitfaden")
IMPERATIVES_DE = ("Verwende", "Achte", "Vermeide", "Halte", "Nutze", "Stelle sicher", "Erledige", "Warte", "Überschreite", "Fasse", "Nenne", "Kennzeichne", "Prüfe", "Melde", "Beginne", "Sprich", "Beantworte", "Frage", "Definiere", "Dokumentiere", "Bleibe", "Antworte", "Erkläre", "Begrüße", "Wiederhole", "Biete", "Speichere", "Protokolliere", "Lösche", "Verweise", "Erläutere", "Formuliere", "Ergänze", "Fülle", "Starte", "Beende")
IMPERATIVES_EN = ("Always", "Never", "Use", "Avoid", "Ensure", "Keep", "Apply", "Do not", "Don't", "Prefer", "Only", "When")
POLICY_TERMS = ("Token-Effizienz", "BatchPrompting", "Batch-Verarbeitung", "Ausgabequalität", "Skeleton-of-Thought", "Kontext-Management", "Output-Management")
TEMPLATE_MARKERS = ("Vorlage", "template", "use this template", "Fill every section", "füllen Sie", "ausfüllen", "Bug Report Template", "Meeting Minutes Template")
STOPWORDS_DE = ("der", "die", "das", "und", "ist", "ein", "eine", "nicht", "auf", "mit", "für", "im", "bei", "wird", "soll", "kann", "du", "deine", "bitte", "sie", "wir")
STOPWORDS_EN = ("the", "and", "is", "a", "to", "of", "for", "with", "you", "your", "should", "will", "can", "not", "this", "that", "be", "in", "on", "it")
NOISE_FILLER = ("hoffe", "danke", "übrigens", "wir hoffen", "gerne", "bitte", "immerhin", "In der heutigen", "In today", "hope", "thanks", "let's", "anyway", "you know", "data is the new oil", "best practices", "industry standards", "synergy", "holistic", "state-of-the-art", "leverage", "world-class", "cutting-edge", "comprehensive framework", "fast-paced environment", "high quality", "professional standards")
SENSITIVE = ("secret", "vertraulich", "datenschutz", "pii", "personenbezogen", "auth", "token", "cve", "schwachstell", "sicherheitslück", "unsicher", "destruktiv", "irreversibel", "finanz", "bank", "medizin", "gesundheit", "personal data")
