"""Values that results depend on, stated a second time: a change of a list has to be meant."""

from corpuswarden.functions.text import PROVIDERS
from corpuswarden.operators import catalogue, findings, flow_rules, module_rules, page_rules, site_rules, standards


def test_lists():
    assert page_rules.AMBIGUOUS == ["click here", "here", "read more", "learn more", "buraya tıkla", "tıkla", "devamı"]
    assert site_rules.MANUAL == ["visual-ux-review", "user-flow-review", "responsive-a11y-review", "cwv-browser-review", "discoverability-review", "conversion-measurement-review"]
    assert module_rules.FALLBACKS == ["*", "/*", "**", "/**", "404", "/404"]
    assert [t for types, _, _, _ in page_rules.PURPOSES for t in types] == ["password", "email", "tel"] and len(page_rules.PURPOSES) == 10
    assert page_rules.UTILITIES == {"aspect": ["auto"], "size": ["auto"], "w": ["auto", "fit", "max", "min"], "h": ["auto", "fit", "max", "min"]}


def test_weights():
    assert catalogue.POINTS == {"critical": 75, "high": 30, "medium": 12, "low": 4, "info": 0}
    assert catalogue.WEIGHTS == {"high": 1.0, "medium": 0.65, "low": 0.35, "unknown": 0.5}
    assert findings.CAP == 50
    assert site_rules.LEAST_LIKELIHOOD == 0.58 and site_rules.PENALTIES == {"cli": 0.3, "library": 0.42, "backend-only": 0.3}


def test_severities_and_providers():
    of = {r[0]: r[3] for r in catalogue.RULES}
    assert {r: of[r] for r in ("server-ssrf", "server-path-traversal", "server-command-injection", "server-sql-injection")} == {"server-ssrf": "high", "server-path-traversal": "high", "server-command-injection": "critical", "server-sql-injection": "critical"}
    high = {"google-api-key", "jwt", "twilio-key"}
    names = {"aws-access-key", "github-token", "gitlab-token", "slack-token", "stripe-live-key", "npm-token", "openai-key", "anthropic-key", "sendgrid-key", "google-oauth-secret"} | high
    assert {n: s for n, _, s in PROVIDERS} == {n: "high" if n in high else "critical" for n in names}


def test_rules_with_standards_are_in_the_catalogue():
    aliases = {"dependency-advisories", "dependency-audit-unavailable"}
    assert set(standards.OF_RULES) - aliases <= {r[0] for r in catalogue.RULES} | {"ci-workflow", "container-hardening", "iac-exposure"}
    assert all(standards.standard(k)[2].startswith("https://") for keys in standards.OF_RULES.values() for k in keys)


def test_patterns_are_made_of_the_names():
    assert flow_rules.one_of(["a.b", "$c", "d/e"]) == "(?:a\\.b|\\$c|d/e)"
    assert flow_rules.free(["x", "y"]) == "(?<![\\w$.])(?:x|y)"
    assert "originalUrl" in flow_rules.REQUEST and "createReadStream" in flow_rules.FILES
