"""Prompt, context and agent-readiness criteria of a document, its risks, and scores from them.

SIGNALS are expressions that a text has or lacks; criteria and risks are SQL expressions over them. So the whole evaluation is two wide projections
within the row: one of booleans, one of what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.gates import Gates, folded
from foliant.functions.text import half_up, plain_rx, squeeze, strip, utf16_length

# Expressions that results depend on. Upper and lower case are equal; ^ and $ are ends of lines.
FENCE = r"```[\s\S]*?```"
HEADING = r"^#{1,3}\s+.+$"
TASK_HEADINGS = r"^#+\s*(?:task|aufgabe|goal|ziel|auftrag)"
#: Of the whole text, blank at neither end.
TYPE_SIGNALS = {
    "workflow_steps": r"(?:workflow|pipeline|step\s+\d|phase\s+\d|process\s+flow|implement.*then.*test|code.*review.*merge|deploy|deployment|run\s+(?:the\s+)?tests?|submit\s+(?:a\s+)?PR|merge\s+(?:if|when|after))",
    "repo_reference": r"(?:github\.com/\w+/\w+|gitlab\.com|bitbucket\.org|repository|repo\b|branch|commit|merge|pull request|PR\b|push\s+(?:to|directly)|production)",
    "code_context": r"(?:src/|tests/|components/|Cargo\.toml|package\.json|\.ts\b|\.rs\b|\.py\b|\.js\b|module|function\s+\w+\s*\(|class\s+\w+|autonomous\s+agent)",
    "ci_gate": r"(?:CI\b|continuous integration|pipeline|build\s+step|lint|linter|gate|check\s+pass)",
    "review_approval": r"(?:code\s+review|reviewer|approval|human\s+approval|genehmigung|freigabe|sign.?off|without\s+review)",
    "issue_tracking": r"(?:issue\s*[#:]\s*\d+|ticket\s*[#:]\s*\d+|task\s*[#:]\s*\d+|bug\s*[#:]\s*\d+)",
    "spec_requirement": r"(?:specification|spec\b|requirements?\s*doc|anforderung|lastenheft|pflichtenheft)",
    "evidence_required": r"(?:evidence|nachweis|beleg|screenshot|log\s+(?:file|output)|proof|verify\s+that)",
    "type_role": r"(?:role|rolle|you are|du bist|act as|agiere als|perspective|perspektive)",
    "type_output": r"(?:output|format|return as|gib zurück|ausgabe|response format)",
    "type_constraint": r"(?:constraint|einschränkung|do not|nicht|avoid|vermeide|begrenzung|limitation)",
    "profile_cold": r"^#+\s*(?:context|kontext|background|hintergrund|umgebung|environment|history|overview|überblick)",
    "profile_warm": r"^#+\s*(?:current\s*state|aktueller\s*stand|status|situation)",
    "profile_hot": r"^#+\s*(?:immediate\s*context|task|aufgabe|goal|ziel|request|problem)",
}
AGENTIC = ("workflow_steps", "repo_reference", "code_context", "ci_gate", "review_approval", "issue_tracking", "spec_requirement", "evidence_required")
ACTIVE = ("workflow_steps", "ci_gate", "review_approval", "spec_requirement")
#: Of the text without sections that hold nothing but a placeholder.
SIGNALS = {
    "action": r"(?:schreibe|erstelle|analysiere|implementiere|konfiguriere|optimiere|refaktoriere|build|create|implement|analyze|configure|generate|refactor|fix|add|remove|update|migrate|develop|design|write|deploy|test|review|document)\s+\w+",
    "specific": r"\b(?:specific|konkret|exactly|genau|precisely|präzise)\b",
    "named_task": r"\b(?:create|build|implement|develop|design|write|fix|add)\s+(?:a|an|the)\s+[\w\s-]{5,}",
    "goal": r"(?:ziel|goal|objective|outcome|ergebnis|result should|das ergebnis|soll\s+\w+\s+(?:werden|sein|liefern|produzieren)|purpose|zweck)",
    "measurable": r"(?:messbar|measurable|quantit|prozent|percent|\d+%|akkurat|accurate|specific|konkret|metric|kennzahl)",
    "role": r"(?:you are (?:a|an)\s|du bist (?:ein|eine)\s|als\s+(?:ein|eine)\s|role\s*:\s|rolle\s*:\s|act as (?:a|an)\s|agiere als\s|perspective\s*:|perspektive\s*:)",
    "profession": r"(?:developer|engineer|designer|architect|analyst|writer|expert|specialist|entwickler|ingenieur)",
    "restricted": r"(?:constraints?\s*:|einschränkungen?\s*:|do not|nicht\s|avoid|vermeide|must not|darf nicht|limitations?\s*:|begrenzungen?\s*:)",
    "constraint_heading": r"^#+\s*(?:constraints?|einschränkungen?|limitations?|begrenzungen?)\s*$",
    "negative": r"(?:never|niemals|under no circumstances|auf keinen fall|forbidden|verboten|prohibited)",
    "format": r"(?:output\s*(?:format|as|should be)|ausgabe\s*(?:format|als)|return\s+(?:as|a|in|the)|gib\s+(?:zurück|aus)\s+(?:als|in)|format\s*:\s*(?:json|markdown|md|yaml|xml|csv|table|tabelle|list|liste|bullet|code)|response\s*(?:format|as|in))",
    "format_heading": r"^#+\s*(?:output\s*format|ausgabe\s*format|ausgabeformat|output|ausgabe)\s*$",
    "named_format": r"(?:JSON|Markdown|YAML|XML|CSV|plain text|code block|React component|function|class|module|endpoint|REST|GraphQL|TypeScript|JavaScript)",
    "quality": r"(?:quality\s*(?:criteria|requirements|gates)|qualität\s*(?:skriterien|sanforderungen)|acceptance\s*criteria|akzeptanzkriterien|must\s+(?:include|contain|have)|soll\s+(?:enthalten|beinhalten)|should\s+(?:include|contain|have))",
    "named_quality": r"(?:performance|security|accessibility|usability|testability|maintainability|performance|sicherheit|barrierefreiheit|testbarkeit|wartbarkeit)",
    "example": r"(?:example|beispiel|reference|referenz|vorlage|template|sample|muster|e\.g\.|for instance|zum beispiel|z\.b\.)",
    "code_block": FENCE,
    "named_example": r"(?:example|beispiel|sample)",
    "verify": r"(?:verify|prüfe|überprüfe|validate|bestätige|confirm|check\s+(?:that|if)|test\s+(?:that|if|whether)|ensure|sicherstellen|stell\s+sicher)",
    "test_command": r"(?:pnpm test|npm test|cargo test|pytest|go test|run tests?|führe tests? aus)",
    "uncertainty": r"(?:if\s+(?:unclear|uncertain|unsure|ambiguous|in doubt)|falls?\s+(?:unklar|unsicher|mehrdeutig|zweifel)|when in doubt|im zweifelsfall|ask\s+(?:if|when|for clarification)|frag\s+(?:nach|wenn)|clarify|kläre)",
    "fallback": r"(?:default\s+to|fallback|alternative|otherwise|andernfalls|stattdessen|instead)",
    "contrast": r"(?:but also|however|on the other hand|andererseits|wobei|allerdings|jedoch.*nicht|sowohl.*als auch.*nicht)",
    "context_heading": r"^#+\s*(?:context|kontext|background|hintergrund|environment|umgebung|situation)",
    "task_terms": r"(?:project|projekt|system|application|anwendung|codebase|codebasis|module|component|komponente|feature|funktion|api|database|datenbank)",
    "task_heading": TASK_HEADINGS,
    "enough_context": r"^#+\s*(?:context|kontext|background|hintergrund|environment|umgebung)",
    "data": r"(?:data|daten|input|eingabe|file|datei|schema|api|endpoint|database|datenbank)",
    "exclusions": r"(?:out of scope|nicht teil|ausgeschlossen|excluded|not included|nicht enthalten|scope\s*:|umfang\s*:)",
    "truth": r"(?:source of truth|authoritative|maßgebend|referenz|reference|see issue|siehe issue|github\.com/\w+/\w+/issues/\d+|gemäß|according to|based on|basierend auf|per\s+(?:spec|issue|ticket|doc))",
    "file_reference": r"(?:file|datei|path|pfad):\s*[^\s,;]+\.[a-z]{2,4}",
    "dated": r"(?:stand\s*:|as of\s*:|dated?\s*:|vom\s*:|last updated|zuletzt aktualisiert|current as of|gültig\s+(?:ab|seit)|version\s+\d+\.\d+)",
    "date": r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}",
    "cold": r"^#+\s*(?:background|hintergrund|history|historie|overview|überblick|foundation|grundlage)",
    "warm": r"^#+\s*(?:current\s*state|aktueller\s*stand|status|environment|umgebung|situation)",
    "hot": r"^#+\s*(?:immediate\s*context|task|aufgabe|goal|ziel|request|anfrage|problem)",
    "excluded": r"(?:out of scope|nicht\s+(?:im\s+)?(?:scope|umfang|teil)|ausgeschlossen|excluded|not\s+(?:relevant|included|needed|required)|nicht\s+(?:relevant|enthalten|benötigt|erforderlich)|ignore|ignoriere|disregard|außer\s+acht\s+lassen)",
    "excluded_heading": r"^#+\s*(?:out of scope|nicht im scope|excluded|ausgeschlossen|not included)",
    "tools": r"(?:only\s+(?:modify|change|edit|update|read|access)|nur\s+(?:ändern|lesen|zugreifen)|available tools?\s*:|verfügbare tools?\s*:|do not\s+(?:modify|change|touch|access)|nicht\s+(?:ändern|anfassen|zugreifen))",
    "file_bounds": r"(?:only\s+(?:in|within)\s|nur\s+(?:in|innerhalb)\s|restrict\s+(?:to|changes to)|beschränke?\s+(?:auf|änderungen auf))",
    "evidence": r"(?:evidence|nachweis|beleg|proof|beweis|show\s+(?:your\s+)?work|zeige\s+(?:deine\s+)?arbeit|document\s+(?:your|the)|dokumentiere|provide\s+(?:evidence|proof|logs?|screenshots?))",
    "artifacts": r"(?:screenshot|bildschirmfoto|log\s+file|logdatei|test\s+output|testergebnis|build\s+output|report)",
    "ar_issue": r"(?:issue|ticket|task|bug)\s*[#:]\s*\d+", "ar_issue_word": r"(?:issue|ticket|task)\b",
    "ar_spec": r"(?:spec\s*:|specification\s*:|requirements?\s*doc|anforderungsdokument|lastenheft|pflichtenheft)", "ar_spec_word": r"(?:spec|specification|anforderung|requirements?\s*(?:doc|document))",
    "ar_verify": r"(?:verification\s*contract|verify\s+that|verify\s+the|prüfe\s+dass|überprüfe|validate\s+(?:that|the)|bestätige|confirm|acceptance\s*(?:criteria|tests|check))", "ar_verify_word": r"(?:verify|prüfe|validate|check|test)",
    "ar_test": r"(?:tests?\s*(?:must|should|need to|sollen|müssen)\s*(?:pass|succeed|be green)|red tests?|unit tests?|integration tests?|e2e tests?|test suite|pnpm test|npm test|cargo test)", "ar_test_word": r"(?:tests?|testing|testen)",
    "ar_ci": r"(?:CI\s*(?:pipeline|gate|check|must|should)|continuous integration|lint\s*(?:must|should|check)|build\s*(?:must|should|succeed|pass)|green\s*(?:pipeline|build|CI))", "ar_ci_word": r"(?:CI\b|pipeline|lint|linter|build\s+step)",
    "ar_review": r"(?:code\s*review|reviewer|PR\s*review|pull\s*request\s*review|review\s*(?:required|needed|mandatory)|review-agent)", "ar_review_word": r"(?:review|prüfung|begutachtung)",
    "ar_approval": r"(?:human\s*approval|menschliche\s*(?:freigabe|genehmigung|prüfung)|approval\s*(?:required|needed|gate|step)|genehmigung\s*(?:erforderlich|notwendig)|freigabe\s*(?:erforderlich|notwendig)|sign.?off|abnahme)", "ar_approval_word": r"(?:approval|genehmigung|freigabe|approve)",
    "ar_evidence": r"(?:evidence\s*(?:required|must|should|log|comment)|nachweis\s*(?:erforderlich|notwendig)|proof\s*of|beleg\s*(?:für|für)|screenshot\s*(?:required|of|showing)|log\s*(?:output|file|must))", "ar_evidence_word": r"(?:evidence|nachweis|beleg|proof)",
    "ar_scope": r"(?:in\s*scope\s*:|out\s*of\s*scope\s*:|scope\s*:\s|im\s*umfang\s*:|nicht\s*im\s*umfang\s*:|umfang\s*:\s|what\s*(?:is|'s)\s*(?:in|out)\s*of\s*scope)", "ar_scope_word": r"(?:scope|umfang|in scope|out of scope)",
    "ar_safety": r"(?:rollback|rücknahme|revert|rückgängig|backup|sicherung|safety\s*(?:measure|check|gate)|sicherheits\s*(?:maßnahme|check)|undo|disaster\s*recovery|fallback\s*plan)", "ar_safety_word": r"(?:safety|sicherheit|backup|rollback)",
    "risk_action": r"(?:schreibe|erstelle|analysiere|implementiere|build|create|implement|analyze|generate|refactor|fix|write|develop|design)",
    "risk_goal": r"(?:ziel|goal|objective|outcome|ergebnis|purpose|zweck|should\s+(?:produce|generate|create|output|return|result)|soll\s+\w+\s+(?:werden|sein|liefern))",
    "risk_format": r"(?:output\s*(?:format|as)|ausgabe\s*(?:format|als)|return\s+(?:as|a|in)|gib\s+(?:zurück|aus)|format\s*:|response\s*format)",
    "risk_constraint": r"(?:constraint|einschränkung|do not|nicht\s|avoid|vermeide|must not|limitation|begrenzung|restriction)",
    "risk_verify": r"(?:verify|prüfe|überprüfe|validate|bestätige|confirm|check\s+(?:that|if)|test\s+(?:that|if)|ensure|sicherstellen)",
    "risk_context": r"(?:context|kontext|background|hintergrund|environment|umgebung|current\s*state|aktueller\s*stand)",
    "risk_fix": r"(?:fix\s+(?:the|a)\s+(?:bug|issue|problem|critical)|bug\s+fix|behebe|repariere)",
    "risk_blog": r"(?:blog\s*post|write\s*(?:a|an)\s*article)", "risk_office": r"(?:order\s+more|office\s+supplies|buy|purchase)", "risk_policy": r"(?:privacy\s*policy|terms\s*of\s*service)", "risk_culture": r"(?:company\s*culture|team\s*building)",
    "risk_code": r"(?:implement|fix\s+bug|refactor|deploy|merge|commit|PR\b|pull\s*request)",
    "risk_scope": r"(?:scope\s*:|umfang\s*:|in\s*scope|out\s*of\s*scope|what\s*(?:is|'s)\s*(?:in|out))",
    "risk_approval": r"(?:human\s*approval|menschliche\s*(?:freigabe|genehmigung)|approval\s*(?:required|needed|gate|step)|genehmigung|freigabe|sign.?off|abnahme)",
    "risk_evidence": r"(?:evidence|nachweis|beleg|proof|verification\s*contract|verify\s+that)",
    "risk_safety": r"(?:rollback|rücknahme|revert|safety|sicherheit|backup|fallback|undo)", "risk_review": r"(?:approval|genehmigung|freigabe|review|prüfung|sign.?off)", "risk_boundary": r"(?:scope|umfang|boundary|grenze|limit|restrict|beschränk)",
    "risk_context_heading": r"^#+\s*(?:context|kontext|background|hintergrund)",
    "risk_date": r"(?:stand\s*:|as of|dated?|vom|last updated|current as of|\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4})",
}
#: Of the same text, without white space at its ends.
VAGUE = {"vague": r"^(?:help|hilf|can you|kannst du|do something|irgendwas|maybe|vielleicht|i need|ich brauche)\b", "risk_vague": r"^(?:help|hilf|can you|kannst du|do something|maybe|vielleicht)"}
COUNTS = {
    "n_headings": HEADING, "n_tasks": TASK_HEADINGS, "n_forbidding": r"\b(?:do not|don't|nicht|kein)\b",
    "n_maybe": r"(?:maybe|vielleicht|perhaps|eventuell|possibly|möglicherweise|or maybe|oder so|kind of|irgendwie)",
    "n_scattered": r"^#+\s*(?:task|aufgabe|noch\s+eine\s+aufgabe|und\s+noch\s+was|goal|ziel|objective)", "n_objectives": r"^#+\s*(?:task|aufgabe|goal|ziel|objective|aufgabe\s*\d|task\s*\d)",
}
PLACEHOLDERS = (r"<!--\s*TODO", r"\bTBD\b", r"requirements?\s+ergänzen", r"verify\s+ergänzen", r"Anforderungen?\s+ergänzen", r"Acceptance\s+Criteria\s+ergänzen", r"Verifikation\s+ergänzen", r"\bplaceholder\b", r"\bPlatzhalter\b")


def steps(two: str, one: str) -> str:
    return f"CASE WHEN {two} THEN 2 WHEN {one} THEN 1 ELSE 0 END"


GATES = Gates(*TYPE_SIGNALS.values(), *SIGNALS.values(), *VAGUE.values(), *COUNTS.values())

PE, CE, AR = "prompt_engineering", "context_engineering", "agent_readiness"
CRITERIA = {
    PE: {
        "Task Clarity": steps("action AND NOT vague AND (specific OR named_task)", "action"),
        "Goal Definition": steps("goal AND measurable", "goal"),
        "Role Definition": steps("role", "profession"),
        "Constraints": steps("(restricted OR constraint_heading) AND negative", "restricted OR constraint_heading OR n_forbidding >= 2"),
        "Output Format": steps("(format OR format_heading) AND named_format", "format OR format_heading"),
        "Quality Criteria": steps("quality AND named_quality", "quality"),
        "Examples": steps("example AND code_block AND named_example", "example"),
        "Verification": steps("verify AND test_command", "verify"),
        "Uncertainty Handling": steps("uncertainty AND fallback", "uncertainty"),
        "Language Clarity": steps("n_maybe <= 3 AND NOT contrast", "n_maybe <= 3 OR NOT contrast"),
    },
    CE: {
        "Context Relevance": steps("context_heading AND task_terms", "context_heading"),
        "Context Sufficiency": steps("task_heading AND enough_context AND data", "(task_heading AND (enough_context OR data)) OR (NOT task_heading AND clean_length > 200)"),
        "Context Economy": steps("clean_length = 0 OR (n_headings = 0 AND clean_length < 500) OR (n_headings > 0 AND clean_length < 500 * n_headings)", "(n_headings = 0 AND clean_length < 1500) OR (n_headings > 0 AND clean_length < 1500 * n_headings)"),
        "Context Isolation": steps("n_tasks <= 1 AND exclusions", "n_tasks <= 1 OR (n_tasks = 2 AND exclusions)"),
        "Source of Truth": steps("truth", "file_reference"),
        "Freshness": steps("dated AND date", "dated OR date"),
        "Context Layers": steps("cold AND warm AND hot", "cold OR warm OR hot"),
        "Excluded Context": steps("excluded_heading", "excluded"),
        "Tool Boundaries": steps("tools AND file_bounds", "tools"),
        "Evidence Requirements": steps("evidence AND artifacts", "evidence"),
    },
    AR: {
        "Issue Reference": steps("ar_issue", "ar_issue_word"), "Specification Reference": steps("ar_spec", "ar_spec_word"), "Verification Contract": steps("ar_verify", "ar_verify_word"),
        "Testing Requirements": steps("ar_test", "ar_test_word"), "CI Gate Awareness": steps("ar_ci", "ar_ci_word"), "Review Process": steps("ar_review", "ar_review_word"),
        "Human Approval": steps("ar_approval", "ar_approval_word"), "Evidence Requirements": steps("ar_evidence", "ar_evidence_word"), "Scope Boundaries": steps("ar_scope", "ar_scope_word"),
        "Safety / Rollback": steps("ar_safety", "ar_safety_word"),
    },
}
SHORT = {PE: "PE", CE: "CE", AR: "AR"}
#: Flag: severity, penalty, condition and message.
RISKS = {
    "ambiguous_task": ("high", 15, "NOT risk_action OR risk_vague", "Task is vague or ambiguous. Add a specific action verb and clear objective."),
    "missing_goal": ("high", 20, "NOT risk_goal", "No clear goal or desired outcome defined. State what the prompt should achieve."),
    "missing_output_format": ("medium", 10, "NOT risk_format", "No output format specified. Define the expected response format (e.g., JSON, Markdown, code)."),
    "missing_constraints": ("medium", 10, "NOT risk_constraint", "No constraints or boundaries defined. Add limitations, non-goals, or restrictions."),
    "missing_verification": ("medium", 15, "(agentic OR clean_length >= 400) AND NOT risk_verify", "No verification criteria defined. Specify how to confirm successful completion."),
    "context_missing": ("medium", 15, "(agentic OR clean_length > 300) AND NOT risk_context", "No context provided for a task that likely needs background information."),
    "context_overload": ("medium", 15, "(clean_length > 1000 AND n_headings < 3) OR (clean_length > 800 AND NOT task_heading) OR (clean_length > 400 AND n_scattered >= 3)", "Context appears overloaded with excessive or irrelevant information. Focus on relevant context."),
    "source_of_truth_missing": ("high", 20, "(agentic OR risk_fix) AND NOT truth", "No source of truth or authoritative reference cited. Specify the canonical data, issue, or document."),
    "mixed_objectives": ("high", 20, "n_objectives > 2 OR (risk_code AND (risk_blog OR risk_office OR risk_policy OR risk_culture)) OR CAST(risk_blog AS INT) + CAST(risk_office AS INT) + CAST(risk_policy AS INT) + CAST(risk_culture AS INT) >= 2", "Multiple unrelated objectives detected. Focus on a single task per prompt."),
    "scope_creep_risk": ("medium", 15, "agentic AND NOT risk_scope", "No clear scope boundaries. Task may expand beyond intended limits."),
    "no_human_approval": ("high", 20, "agentic AND NOT risk_approval", "No human approval gate specified. Add an explicit approval step before finalization."),
    "no_evidence_contract": ("high", 20, "agentic AND NOT risk_evidence", "No evidence contract defined. Specify what proof of completion is required."),
    "unbounded_agent_autonomy": ("critical", 25, "agentic AND NOT risk_safety AND NOT risk_review AND NOT risk_boundary", "Agent is given unbounded autonomy without safety measures. Add rollback plan, scope limits, and approval gates."),
    "stale_or_undated_context": ("low", 10, "risk_context_heading AND NOT risk_date", "Context lacks temporal reference. Add a date or version to indicate freshness."),
}
MISSING = {
    "Task Clarity": 'Add a clear action verb and specific task, e.g., "Implement the UserAuth module in TypeScript."',
    "Goal Definition": 'Define the desired outcome, e.g., "The result should be a working REST endpoint that passes all tests."',
    "Role Definition": 'Specify a role or perspective, e.g., "You are a senior backend developer."',
    "Constraints": 'Add constraints and boundaries, e.g., "Do not use external libraries. Must work offline."',
    "Output Format": 'Define the expected output format, e.g., "Return a Markdown checklist with acceptance criteria."',
    "Quality Criteria": 'Specify quality requirements, e.g., "The code must have >80% test coverage and pass lint."',
    "Examples": 'Provide an example or reference, e.g., "See auth.rs for the existing implementation pattern."',
    "Verification": 'Add verification criteria, e.g., "Run pnpm test and confirm all tests pass."',
    "Uncertainty Handling": 'Define fallback behavior, e.g., "If the data format is unclear, ask for clarification before proceeding."',
    "Language Clarity": "Simplify and remove ambiguous language. Use specific terms and avoid contradictions.",
    "Context Relevance": "Add a relevant Context section that provides background directly related to the task.",
    "Context Sufficiency": "Provide enough context for the task, including relevant data, files, or system state.",
    "Context Economy": "Reduce context to only what is necessary. Move lengthy background to an appendix or reference.",
    "Context Isolation": 'Separate this task from other concerns. Add an "Out of Scope" section to define boundaries.',
    "Source of Truth": 'Define an authoritative source, e.g., "Use GitHub issue #67 and current master as authoritative context."',
    "Freshness": 'Add a date or version reference, e.g., "Stand: 2026-06-14, based on design v3.2."',
    "Context Layers": 'Structure context in layers, e.g., "Background → Current State → Immediate Context."',
    "Excluded Context": 'Explicitly state what is NOT relevant, e.g., "Not relevant: deployment configuration, monitoring setup."',
    "Tool Boundaries": 'Define file and tool access boundaries, e.g., "Only modify files in src/components/."',
    "Evidence Requirements": 'Specify evidence needed, e.g., "Provide a screenshot of passing tests and the CI pipeline status."',
}
PARTIAL = {
    "Task Clarity": "Strengthen the task description with a more specific action verb and objective.",
    "Goal Definition": "Make the goal more measurable. Add concrete success criteria.",
    "Role Definition": "Make the role more specific, e.g., add domain expertise level or context.",
    "Constraints": "Add more specific constraints or non-goals to tighten scope.",
    "Output Format": "Be more specific about the output format. Name the exact format and structure.",
    "Quality Criteria": "Add measurable quality criteria, e.g., test coverage percentage, performance thresholds.",
    "Examples": "Add a concrete code example or reference implementation.",
    "Verification": "Make verification more specific. Add exact commands or expected outputs.",
    "Uncertainty Handling": "Add fallback instructions for edge cases or ambiguous situations.",
    "Language Clarity": "Reduce remaining ambiguity. Replace vague terms with specific ones.",
    "Context Relevance": "Focus context more tightly on task-relevant information.",
    "Context Sufficiency": "Add more task-relevant context details.",
    "Context Economy": "Further trim extraneous context to improve signal-to-noise ratio.",
    "Context Isolation": "Strengthen task isolation. Add clearer boundaries between concerns.",
    "Source of Truth": "Make the source of truth more explicit with a direct link or reference.",
    "Freshness": "Add a specific date or version number to the freshness reference.",
    "Context Layers": "Add more context layers (Background, Current State, Immediate Context).",
    "Excluded Context": "Make exclusions more explicit with a dedicated section.",
    "Tool Boundaries": "Be more specific about which files and tools are in/out of scope.",
    "Evidence Requirements": "Specify exact evidence artifacts needed (screenshots, logs, test reports).",
}
AGENT_MISSING = {
    "Issue Reference": 'Link to a specific issue, e.g., "Implement per GitHub Issue #42."',
    "Specification Reference": 'Reference the specification, e.g., "Follow the requirements in docs/spec/auth.md."',
    "Verification Contract": 'Define a verification contract, e.g., "Verify that all tests pass and the build is green."',
    "Testing Requirements": 'Add testing requirements, e.g., "Run pnpm test and ensure all tests pass."',
    "CI Gate Awareness": 'Reference CI gates, e.g., "The CI pipeline (lint + test + build) must be green."',
    "Review Process": 'Add a review step, e.g., "Request a code review from the reviewer-agent."',
    "Human Approval": 'Add a human approval gate, e.g., "Await human approval before merging."',
    "Evidence Requirements": 'Require evidence of completion, e.g., "Post CI results as evidence in the issue."',
    "Scope Boundaries": 'Define scope, e.g., "In scope: auth module. Out of scope: UI changes, deployment."',
    "Safety / Rollback": 'Add a safety measure, e.g., "Create a backup branch before making changes."',
}
EMPTY_WARNING, EMPTY_MISSING, EMPTY_DETAILS = "Prompt is empty. Add content to enable evaluation.", "No prompt content to evaluate.", "Missing: prompt has no content."
EMPTY_ADVICE = (PE, "task_clarity", "Start by writing a clear task with an action verb and specific objective.", "high")
EMPTY_RISKS = (("ambiguous_task", "high", "No prompt content provided.", 15), ("missing_goal", "high", "No goal or objective specified.", 20))
#: Shares of the prompt, context, agent and robustness scores in the overall score.
SHARES = {"agentic_prompt": (0.35, 0.25, 0.25, 0.15), "structured_prompt": (0.45, 0.3, 0.0, 0.25), "simple_prompt": (0.6, 0.25, 0.0, 0.15)}
CORE = ("Task Clarity", "Goal Definition", "Language Clarity")


def matching(pattern: str) -> str:
    return plain_rx(pattern, "ium")


def matched(column: str, table: dict[str, str], gates: Gates) -> dict[str, Column]:
    """Whether a column matches each expression, by name, where `_passed`, of a text that holds it, lets it."""
    return {n: gates.may(F.col("_passed"), p) & F.col(column).rlike(matching(p)) for n, p in table.items()}


def counted(column: str, table: dict[str, str], gates: Gates) -> dict[str, Column]:
    """As matched(), how often."""
    return {n: F.when(gates.may(F.col("_passed"), p), F.regexp_count(column, F.lit(matching(p)))).otherwise(0) for n, p in table.items()}


def without_placeholders(text: Column) -> Column:
    """Without the sections that hold nothing but white space, comments or a placeholder; what stands before the first heading stays."""
    heading = r"#{1,3}[^\S\n]"
    pieces = F.split(text, rf"\n(?={heading})", -1)

    def hollow(body: Column) -> Column:
        rest = squeeze(F.regexp_replace(body, r"<!--[\s\S]*?-->", ""))
        alone = F.lit(False)
        for p in PLACEHOLDERS:
            alone = alone | rest.rlike(plain_rx(rf"^\s*(?:{p})\s*$"))
        return (rest == "") | ((F.length(rest) < 60) & alone)

    def kept(x: Column) -> Column:
        lines = F.instr(x, "\n")
        return ~x.rlike(rf"\A{heading}") | (lines == 0) | ~hollow(F.substring(x, lines + 1, F.length(x)))

    return F.array_join(F.filter(pieces, kept), "\n")


def without_code(text: Column) -> Column:
    return F.regexp_replace(text, FENCE, "")


def scored(dimension: str) -> Column:
    """The criteria of a dimension as structs."""

    def one(name: str) -> Column:
        score = F.col(column_of(dimension, name))
        details = F.when(score == 0, f"Missing: {name} is not addressed in the prompt.").when(score == 1, f"Partially present: {name} is mentioned but could be strengthened.").otherwise(f"Clearly defined: {name} is well-specified in the prompt.")
        return F.struct(F.lit(dimension).alias("dimension"), F.lit(name).alias("name"), score.alias("score"), F.lit(2).alias("max_score"), details.alias("details"))

    return F.array(*map(one, CRITERIA[dimension]))


def column_of(dimension: str, name: str) -> str:
    return f"{SHORT[dimension]} {name}".replace(" ", "_").replace("/", "_")


def advice(dimension: str, name: str, message: Column, priority: str) -> Column:
    return F.struct(F.lit(dimension).alias("dimension"), F.lit(name).alias("criterion"), message.alias("message"), F.lit(priority).alias("priority"))


def by_name(table: dict[str, str], name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), name)


def improvements() -> Column:
    """What to improve, the urgent first and each message once: what is missing, what is partial, agent criteria, and grave risks."""
    of = lambda array, score, table: F.transform(F.filter(array, lambda c: c["score"] == score), lambda c: F.struct(c["dimension"].alias("dimension"), c["name"].alias("criterion"), by_name(table, c["name"]).alias("message"), F.lit("high" if table is MISSING else "medium").alias("priority")))
    both = F.concat("_pe", "_ce")
    missing = F.transform(of(both, 0, MISSING), lambda a: a.withField("priority", F.when(a["dimension"] == PE, "high").otherwise("medium")))
    agent = F.transform(F.filter("_ar", lambda c: c["score"] < 2), lambda c: F.struct(
        c["dimension"].alias("dimension"), c["name"].alias("criterion"),
        F.when(c["score"] == 0, by_name(AGENT_MISSING, c["name"])).otherwise(F.concat(F.lit("Strengthen the "), F.lower(c["name"]), F.lit(" in the agent workflow with more specific details."))).alias("message"),
        F.when(c["score"] == 0, "high").otherwise("medium").alias("priority"),
    ))
    grave = F.transform(F.filter("risk_flags", lambda r: r["severity"].isin("high", "critical")), lambda r: F.struct(F.lit(PE).alias("dimension"), r["flag"].alias("criterion"), r["message"].alias("message"), F.lit("high").alias("priority")))
    return F.concat(missing, of(both, 1, PARTIAL), agent, grave)


def first_by(array: str, field: str) -> Column:
    """Elements whose field no earlier element has."""
    keys = F.transform(array, lambda x: x[field])
    numbered = F.transform(array, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda s: F.array_position(keys, s["x"][field]) == s["i"] + 1), lambda s: s["x"])


def signalled(docs: DataFrame, text: str) -> DataFrame:
    """docs with a column for each signal and count, lengths, and agentic."""
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumns({"_whole": strip(F.col("_text")), "_eval": without_placeholders(F.col("_text"))})
    df = df.withColumns({"_stripped": strip(F.col("_eval")), "clean_length": utf16_length(without_code(F.col("_eval"))), "whole_clean_length": utf16_length(without_code(F.col("_whole")))})
    # What stands in a part of the text stands in the whole, so one search for the words of the gates serves all.
    df = df.withColumn("_passed", GATES.passed(folded(F.col("_text"))))
    df = df.withColumns(matched("_whole", TYPE_SIGNALS, GATES) | matched("_eval", SIGNALS, GATES) | matched("_stripped", VAGUE, GATES) | counted("_eval", COUNTS, GATES) | counted("_whole", {"whole_headings": HEADING}, GATES))
    return df.withColumn("agentic", F.expr(AGENTIC_SQL))


AGENTIC_SQL = "(" + " + ".join(f"CAST({s} AS INT)" for s in AGENTIC) + ") >= 3 AND (" + " OR ".join(ACTIVE) + ")"
TYPE_SQL = "CASE WHEN agentic THEN 'agentic_prompt' WHEN CAST(whole_headings >= 1 AS INT) + CAST(type_role AS INT) + CAST(type_output AS INT) + CAST(type_constraint AS INT) >= 2 THEN 'structured_prompt' ELSE 'simple_prompt' END"
LAYERS_SQL = "(CAST(profile_cold AS INT) + CAST(profile_warm AS INT) + CAST(profile_hot AS INT))"
PROFILE_SQL = f"CASE WHEN whole_clean_length > 2000 AND profile_hot AND profile_cold AND {LAYERS_SQL} < 3 THEN 'overloaded' WHEN {LAYERS_SQL} >= 3 THEN 'rich' WHEN {LAYERS_SQL} >= 2 THEN 'moderate' WHEN (profile_cold AND whole_clean_length > 100) OR (profile_hot AND whole_clean_length > 200) THEN 'moderate' ELSE 'minimal' END"


def evaluated(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with detected_prompt_type, detected_context_profile, the four scores and overall_score, criteria, strengths, warnings, missing_elements,
    suggested_improvements, risk_flags and confidence.

    Null and blank texts score 0 and are told so. Columns of the same names are replaced."""
    before = docs.columns
    df = signalled(docs, text).withColumn("blank", F.col("_whole") == "")
    df = df.withColumns({"detected_prompt_type": F.expr(TYPE_SQL), "detected_context_profile": F.expr(PROFILE_SQL)})
    df = df.withColumns({column_of(d, n): F.expr(sql) for d, cs in CRITERIA.items() for n, sql in cs.items()})
    flag = lambda name, severity, penalty, message: F.struct(F.lit(name).alias("flag"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(penalty).alias("score_penalty"))
    flags = F.array_compact(F.array(*(F.when(F.expr(sql), flag(n, s, p, m)) for n, (s, p, sql, m) in RISKS.items())))
    empty_flags = F.array(*(flag(n, s, p, m) for n, s, m, p in EMPTY_RISKS))
    none = F.expr("cast(array() as array<struct<dimension: string, name: string, score: int, max_score: int, details: string>>)")
    hollow = lambda d: F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(n).alias("name"), F.lit(0).alias("score"), F.lit(2).alias("max_score"), F.lit(EMPTY_DETAILS).alias("details")) for n in CRITERIA[d]))
    df = df.withColumns({
        "risk_flags": F.when(F.col("blank"), empty_flags).otherwise(flags), "_pe": F.when(F.col("blank"), hollow(PE)).otherwise(scored(PE)), "_ce": F.when(F.col("blank"), hollow(CE)).otherwise(scored(CE)),
        "_ar": F.when(F.col("agentic") & ~F.col("blank"), scored(AR)).otherwise(none),
    })
    total = lambda array: F.aggregate(array, F.lit(0), lambda a, c: a + c["score"])
    zero = lambda array, *names: F.size(F.filter(array, lambda c: (c["score"] == 0) & (c["name"].isin(*names) if names else F.lit(True))))
    penalties = F.aggregate("risk_flags", F.lit(0), lambda a, r: a + r["score_penalty"])
    gaps = F.when(F.col("detected_prompt_type") == "simple_prompt", 3 * zero("_pe", *CORE)).otherwise(3 * zero("_pe") + 3 * zero("_ce") + 5 * zero("_ar"))
    whole = {"prompt_engineering_score": 5 * total("_pe"), "context_engineering_score": 5 * total("_ce"), "agent_readiness_score": 5 * total("_ar"), "robustness_score": F.greatest(F.lit(0), 100 - penalties - gaps)}
    df = df.withColumns({n: F.when(F.col("blank"), 0).otherwise(c).cast("int") for n, c in whole.items()})
    mean = lambda shares: sum((F.col(n) * s for n, s in zip(whole, shares, strict=True) if s), F.lit(0.0))
    kind = F.col("detected_prompt_type")
    overall = F.when(kind == "agentic_prompt", mean(SHARES["agentic_prompt"])).when(kind == "structured_prompt", mean(SHARES["structured_prompt"])).otherwise(mean(SHARES["simple_prompt"]))
    df = df.withColumn("overall_score", F.greatest(F.lit(0), F.least(F.lit(100), half_up(overall))).cast("int"))
    df = df.withColumn("criteria", F.concat("_pe", "_ce", "_ar")).withColumn("_advice", improvements())
    label = lambda c: F.concat(F.lit("["), F.when(c["dimension"] == PE, "PE").when(c["dimension"] == CE, "CE").otherwise("AR"), F.lit("] "), c["name"], F.lit(": "), c["details"])
    told = lambda score, empty: F.when(F.col("blank"), F.array(*map(F.lit, empty)).cast("array<string>")).otherwise(F.transform(F.filter("criteria", lambda c: c["score"] == score), label))
    share = F.size(F.filter("criteria", lambda c: c["score"] > 0)) / F.size("criteria")
    df = df.withColumn("_advice", F.concat(F.filter("_advice", lambda a: a["priority"] == "high"), F.filter("_advice", lambda a: a["priority"] != "high")))
    d, n, m, p = EMPTY_ADVICE
    df = df.withColumns({
        "strengths": told(2, ()), "warnings": told(1, (EMPTY_WARNING,)), "missing_elements": told(0, (EMPTY_MISSING,)),
        "suggested_improvements": F.when(F.col("blank"), F.array(advice(d, n, F.lit(m), p))).otherwise(first_by("_advice", "message")),
        "confidence": F.when(F.col("blank"), 1.0).otherwise(half_up((0.2 + share * 0.8) * 100) / 100),
    })
    new = ["detected_prompt_type", "detected_context_profile", *whole, "overall_score", "criteria", "strengths", "warnings", "missing_elements", "suggested_improvements", "risk_flags", "confidence"]
    return df.select(*(c for c in before if c not in new), *new)
