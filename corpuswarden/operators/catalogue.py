"""The rules: a row for each with its id, mode, category, severity, confidence, whether a person has to judge, and the
score family. Add a row to add a rule."""

from __future__ import annotations

SEVERITIES = ("critical", "high", "medium", "low", "info")
# Risk points of a severity and weights of a confidence.
POINTS = {"critical": 75, "high": 30, "medium": 12, "low": 4, "info": 0}
WEIGHTS = {"high": 1.0, "medium": 0.65, "low": 0.35, "unknown": 0.5}

SCHEMA = "rule_id string, mode string, category string, severity string, confidence string, manual boolean, family string"
# The rules with their ids, severities and confidences.
RULES = [
    ("seo-missing-title", "site", "seo", "high", "high", False, "seo-missing-title"),
    ("seo-multiple-titles", "site", "seo", "medium", "high", False, "seo-multiple-titles"),
    ("seo-missing-description", "site", "seo", "medium", "high", False, "seo-missing-description"),
    ("seo-missing-social-metadata", "site", "seo", "low", "high", False, "seo-missing-social-metadata"),
    ("seo-incomplete-social-metadata", "site", "seo", "low", "high", False, "seo-missing-social-metadata"),
    ("seo-invalid-social-url", "site", "seo", "low", "high", False, "seo-missing-social-metadata"),
    ("seo-missing-canonical", "site", "seo", "low", "medium", False, "seo-missing-canonical"),
    ("seo-multiple-canonicals", "site", "seo", "medium", "high", False, "seo-missing-canonical"),
    ("seo-invalid-canonical", "site", "seo", "medium", "high", False, "seo-missing-canonical"),
    ("seo-insecure-canonical", "site", "seo", "low", "high", False, "seo-missing-canonical"),
    ("seo-page-noindex", "site", "seo", "medium", "medium", False, "seo-page-noindex"),
    ("seo-invalid-structured-data", "site", "seo", "medium", "high", False, "seo-invalid-structured-data"),
    ("seo-duplicate-static-title", "site", "seo", "medium", "high", False, "seo-duplicate-static-title"),
    ("seo-duplicate-static-description", "site", "seo", "low", "high", False, "seo-duplicate-static-description"),
    ("seo-markdown-empty-title", "site", "seo", "medium", "high", False, "seo-markdown-empty-title"),
    ("seo-markdown-empty-description", "site", "seo", "medium", "high", False, "seo-markdown-empty-description"),
    ("seo-markdown-missing-description", "site", "seo", "low", "medium", True, "seo-markdown-missing-description"),
    ("seo-markdown-empty-canonical", "site", "seo", "low", "high", False, "seo-markdown-empty-canonical"),
    ("a11y-document-language", "site", "a11y", "medium", "high", False, "a11y-document-language"),
    ("a11y-viewport-zoom", "site", "a11y", "high", "high", False, "a11y-viewport-zoom"),
    ("a11y-meta-refresh", "site", "a11y", "low", "high", False, "a11y-meta-refresh"),
    ("a11y-image-alt", "site", "a11y", "high", "high", False, "a11y-image-alt"),
    ("a11y-iframe-title", "site", "a11y", "medium", "high", False, "a11y-iframe-title"),
    ("a11y-audible-autoplay", "site", "a11y", "medium", "high", False, "a11y-audible-autoplay"),
    ("a11y-control-name", "site", "a11y", "high", "high", False, "a11y-control-name"),
    ("a11y-image-input-alt", "site", "a11y", "high", "high", False, "a11y-image-input-alt"),
    ("a11y-dialog-name", "site", "a11y", "high", "high", False, "a11y-dialog-name"),
    ("a11y-interactive-nesting", "site", "a11y", "high", "high", False, "a11y-interactive-nesting"),
    ("a11y-fieldset-legend", "site", "a11y", "medium", "high", False, "a11y-fieldset-legend"),
    ("a11y-table-name", "site", "a11y", "low", "medium", True, "a11y-table-name"),
    ("a11y-link-name", "site", "a11y", "high", "high", False, "a11y-link-name"),
    ("a11y-clickable-noncontrol", "site", "a11y", "high", "high", False, "a11y-clickable-noncontrol"),
    ("a11y-svg-image-name", "site", "a11y", "high", "high", False, "a11y-svg-image-name"),
    ("a11y-form-label", "site", "a11y", "high", "high", False, "a11y-form-label"),
    ("a11y-positive-tabindex", "site", "a11y", "medium", "high", False, "a11y-positive-tabindex"),
    ("a11y-focusable-aria-hidden", "site", "a11y", "high", "high", False, "a11y-focusable-aria-hidden"),
    ("a11y-duplicate-id", "site", "a11y", "medium", "high", False, "a11y-duplicate-id"),
    ("a11y-video-captions", "site", "a11y", "medium", "medium", False, "a11y-video-captions"),
    ("a11y-markdown-image-alt-review", "site", "a11y", "low", "medium", True, "a11y-markdown-image-alt-review"),
    ("a11y-focus-indicator-removed", "site", "a11y", "high", "medium", False, "a11y-focus-indicator-removed"),
    ("a11y-missing-main-landmark", "site", "a11y", "medium", "medium", False, "a11y-missing-main-landmark"),
    ("a11y-motion-no-reduction", "site", "a11y", "medium", "high", False, "a11y-motion-no-reduction"),
    ("html-missing-charset", "site", "html", "low", "high", False, "html-missing-charset"),
    ("responsive-missing-viewport", "site", "responsive", "high", "high", False, "responsive-missing-viewport"),
    ("responsive-rigid-width", "site", "responsive", "medium", "medium", False, "responsive-rigid-width"),
    ("responsive-no-breakpoint-strategy", "site", "responsive", "medium", "medium", False, "responsive-no-breakpoint-strategy"),
    ("performance-render-blocking-script", "site", "performance", "low", "medium", False, "performance-render-blocking-script"),
    ("performance-image-dimensions", "site", "performance", "low", "medium", False, "performance-image-dimensions"),
    ("performance-priority-image-lazy", "site", "performance", "medium", "high", False, "performance-priority-image-lazy"),
    ("performance-css-import", "site", "performance", "low", "high", False, "performance-css-import"),
    ("performance-font-display", "site", "performance", "low", "high", False, "performance-font-display"),
    ("performance-transition-all", "site", "performance", "low", "high", False, "performance-transition-all"),
    ("performance-large-image-asset", "site", "performance", "low", "medium", True, "performance-large-image-asset"),
    ("performance-legacy-image-format", "site", "performance", "low", "medium", True, "performance-legacy-image-format"),
    ("performance-large-gif-asset", "site", "performance", "low", "medium", True, "performance-large-gif-asset"),
    ("performance-large-font-asset", "site", "performance", "low", "medium", True, "performance-large-font-asset"),
    ("performance-large-media-asset", "site", "performance", "low", "medium", True, "performance-large-media-asset"),
    ("performance-large-wasm-asset", "site", "performance", "medium", "medium", True, "performance-large-wasm-asset"),
    ("performance-large-source-file", "site", "performance", "medium", "medium", False, "performance-large-source-file"),
    ("ux-ambiguous-link-text", "site", "ux", "low", "high", False, "ux-ambiguous-link-text"),
    ("ux-small-text", "site", "ux", "low", "medium", False, "ux-small-text"),
    ("ux-document-scroll-disabled", "site", "ux", "medium", "medium", False, "ux-document-scroll-disabled"),
    ("ux-missing-navigation-landmark", "site", "ux", "low", "medium", False, "ux-missing-navigation-landmark"),
    ("ux-no-loading-state", "site", "ux", "low", "medium", True, "ux-no-loading-state"),
    ("ux-no-error-state", "site", "ux", "low", "medium", True, "ux-no-error-state"),
    ("ux-no-empty-state", "site", "ux", "info", "medium", True, "ux-no-empty-state"),
    ("ux-no-not-found-page", "site", "ux", "low", "medium", False, "ux-no-not-found-page"),
    ("security-external-link-opener", "site", "security", "medium", "high", False, "security-external-link-opener"),
    ("security-insecure-resource", "site", "security", "high", "high", False, "security-insecure-resource"),
    ("forms-missing-autocomplete", "site", "forms", "low", "high", False, "forms-missing-autocomplete"),
    ("forms-implicit-button-type", "site", "forms", "low", "high", False, "forms-implicit-button-type"),
    ("forms-no-validation-signal", "site", "forms", "low", "medium", True, "forms-no-validation-signal"),
    ("forms-no-error-feedback-signal", "site", "forms", "medium", "medium", True, "forms-no-error-feedback-signal"),
    ("content-missing-h1", "site", "content", "medium", "medium", False, "content-missing-h1"),
    ("content-multiple-h1", "site", "content", "low", "medium", True, "content-multiple-h1"),
    ("content-empty-heading", "site", "content", "medium", "high", False, "content-empty-heading"),
    ("content-heading-jump", "site", "content", "low", "high", False, "content-heading-jump"),
    ("privacy-password-get-form", "site", "privacy", "high", "high", False, "privacy-password-get-form"),
    ("privacy-sensitive-browser-storage", "site", "privacy", "high", "medium", False, "privacy-sensitive-browser-storage"),
    ("privacy-analytics-without-consent-signal", "site", "privacy", "medium", "medium", True, "privacy-analytics-without-consent-signal"),
    ("compat-browser-global-on-server", "site", "compat", "medium", "medium", False, "compat-browser-global-on-server"),
    ("compat-no-browser-policy", "site", "compat", "low", "medium", False, "compat-no-browser-policy"),
    ("compat-no-browser-tests", "site", "compat", "info", "medium", True, "compat-no-browser-tests"),
    ("design-large-component", "site", "design", "low", "medium", False, "design-large-component"),
    ("design-no-color-tokens", "site", "design", "low", "medium", False, "design-no-color-tokens"),
    ("crawl-robots-unvalidated", "site", "crawl", "medium", "medium", True, "crawl-robots-unvalidated"),
    ("crawl-sitemap-unvalidated", "site", "crawl", "low", "medium", True, "crawl-sitemap-unvalidated"),
    ("crawl-missing-robots", "site", "crawl", "low", "high", False, "crawl-missing-robots"),
    ("crawl-invalid-robots", "site", "crawl", "medium", "high", False, "crawl-invalid-robots"),
    ("crawl-unsupported-noindex", "site", "crawl", "medium", "high", False, "crawl-unsupported-noindex"),
    ("crawl-sitewide-disallow", "site", "crawl", "high", "high", False, "crawl-sitewide-disallow"),
    ("crawl-robots-missing-sitemap", "site", "crawl", "low", "high", False, "crawl-robots-missing-sitemap"),
    ("crawl-invalid-sitemap-directive", "site", "crawl", "medium", "high", False, "crawl-invalid-sitemap-directive"),
    ("crawl-missing-sitemap", "site", "crawl", "low", "high", False, "crawl-missing-sitemap"),
    ("crawl-invalid-sitemap", "site", "crawl", "medium", "high", False, "crawl-invalid-sitemap"),
    ("crawl-sitemap-namespace", "site", "crawl", "low", "high", False, "crawl-sitemap-namespace"),
    ("crawl-empty-sitemap", "site", "crawl", "medium", "high", False, "crawl-empty-sitemap"),
    ("crawl-invalid-sitemap-location", "site", "crawl", "medium", "high", False, "crawl-invalid-sitemap-location"),
    ("crawl-insecure-sitemap-location", "site", "crawl", "low", "high", False, "crawl-insecure-sitemap-location"),
    ("crawl-duplicate-sitemap-location", "site", "crawl", "low", "high", False, "crawl-duplicate-sitemap-location"),
    ("discoverability-no-structured-data", "site", "discoverability", "low", "high", False, "discoverability-no-structured-data"),
    ("project-invalid-package-json", "site", "project", "high", "high", False, "project-invalid-package-json"),
    ("manual-visual-ux-review", "site", "manual", "info", "medium", True, "manual-visual-ux-review"),
    ("manual-user-flow-review", "site", "manual", "info", "medium", True, "manual-user-flow-review"),
    ("manual-responsive-a11y-review", "site", "manual", "info", "medium", True, "manual-responsive-a11y-review"),
    ("manual-cwv-browser-review", "site", "manual", "info", "medium", True, "manual-cwv-browser-review"),
    ("manual-discoverability-review", "site", "manual", "info", "medium", True, "manual-discoverability-review"),
    ("manual-conversion-measurement-review", "site", "manual", "info", "medium", True, "manual-conversion-measurement-review"),
    ("embedded-secrets", "security", "secrets", "critical", "high", False, "embedded-secrets"),
    ("public-env-secrets", "security", "secrets", "high", "high", False, "public-env-secrets"),
    ("hardcoded-auth", "security", "secrets", "critical", "high", False, "hardcoded-auth"),
    ("dom-xss", "security", "injection", "high", "high", False, "dom-xss"),
    ("dynamic-code", "security", "injection", "high", "high", False, "dynamic-code"),
    ("server-ssrf", "security", "injection", "high", "high", True, "server-ssrf"),
    ("server-path-traversal", "security", "injection", "high", "high", True, "server-path-traversal"),
    ("server-command-injection", "security", "injection", "critical", "high", True, "server-command-injection"),
    ("server-sql-injection", "security", "injection", "critical", "high", True, "server-sql-injection"),
    ("insecure-transport", "security", "transport", "medium", "high", False, "insecure-transport"),
    ("cors", "security", "transport", "high", "high", False, "cors"),
    ("security-headers", "security", "transport", "medium", "high", False, "security-headers"),
    ("embedded-content", "security", "transport", "low", "high", True, "embedded-content"),
    ("third-party-resources", "security", "transport", "medium", "high", False, "third-party-resources"),
    ("browser-storage", "security", "browser", "high", "high", False, "browser-storage"),
    ("cross-window-messaging", "security", "browser", "high", "high", False, "cross-window-messaging"),
    ("external-navigation", "security", "browser", "low", "high", False, "external-navigation"),
    ("untrusted-navigation", "security", "browser", "high", "medium", True, "untrusted-navigation"),
    ("cookie-flags", "security", "browser", "high", "high", False, "cookie-flags"),
    ("sensitive-logging", "security", "browser", "medium", "high", False, "sensitive-logging"),
    ("weak-cryptography", "security", "crypto", "medium", "high", False, "weak-cryptography"),
    ("jwt-validation", "security", "crypto", "critical", "high", False, "jwt-validation"),
    ("dependency-hygiene", "security", "supply", "medium", "high", False, "dependency-hygiene"),
    ("package-scripts", "security", "supply", "high", "high", False, "package-scripts"),
    ("lockfile", "security", "supply", "medium", "high", False, "lockfile"),
    ("lockfile-integrity", "security", "supply", "medium", "high", False, "lockfile-integrity"),
    ("environment-hygiene", "security", "supply", "medium", "high", False, "environment-hygiene"),
    ("dependency-advisory", "security", "supply", "medium", "high", False, "dependency-advisory"),
    ("source-maps", "security", "supply", "medium", "medium", False, "source-maps"),
    ("ci-workflow", "security", "platform", "high", "high", False, "ci-workflow"),
    ("container-hardening", "security", "platform", "high", "high", False, "container-hardening"),
    ("iac-exposure", "security", "platform", "high", "high", False, "iac-exposure"),
    ("runtime.header-csp-missing", "site", "headers", "medium", "medium", True, "runtime.header-csp-missing"),
    ("runtime.header-csp-unsafe-eval", "site", "headers", "high", "high", False, "runtime.header-csp-unsafe-eval"),
    ("runtime.header-nosniff-missing", "site", "headers", "low", "medium", True, "runtime.header-nosniff-missing"),
    ("runtime.header-frame-protection-missing", "site", "headers", "low", "medium", True, "runtime.header-frame-protection-missing"),
    ("runtime.header-referrer-policy-missing", "site", "headers", "low", "medium", True, "runtime.header-referrer-policy-missing"),
    ("runtime.header-referrer-policy-weak", "site", "headers", "medium", "high", False, "runtime.header-referrer-policy-weak"),
    ("runtime.header-hsts-missing", "site", "headers", "medium", "medium", True, "runtime.header-hsts-missing"),
    ("runtime.http-error", "site", "headers", "medium", "high", False, "runtime.http-error"),
    ("runtime.document-content-type", "site", "headers", "medium", "high", False, "runtime.document-content-type"),
    ("runtime.document-title", "site", "document", "medium", "high", False, "seo-missing-title"),
    ("runtime.missing-h1", "site", "document", "low", "high", False, "content-missing-h1"),
    ("runtime.missing-landmarks", "site", "document", "low", "high", False, "runtime.missing-landmarks"),
    ("runtime.document-language", "site", "document", "medium", "high", False, "a11y-document-language"),
    ("runtime.invalid-document-language", "site", "document", "medium", "high", False, "runtime.invalid-document-language"),
    ("runtime.viewport", "site", "document", "medium", "high", False, "responsive-missing-viewport"),
    ("runtime.meta-description", "site", "document", "low", "high", False, "seo-missing-description"),
    ("runtime.canonical-url", "site", "document", "low", "high", False, "seo-missing-canonical"),
    ("runtime.horizontal-overflow", "site", "document", "medium", "high", False, "runtime.horizontal-overflow"),
    ("runtime.unlabeled-controls", "site", "interface", "high", "high", False, "a11y-form-label"),
    ("runtime.duplicate-ids", "site", "interface", "low", "high", False, "a11y-duplicate-id"),
    ("runtime.broken-images", "site", "interface", "medium", "high", False, "runtime.broken-images"),
    ("runtime.small-touch-targets", "site", "interface", "low", "medium", True, "runtime.small-touch-targets"),
    ("runtime.axe", "site", "interface", "medium", "high", False, "runtime.axe"),
    ("runtime.axe-incomplete-review", "site", "interface", "info", "medium", True, "runtime.axe-incomplete-review"),
    ("runtime.axe-results-truncated", "site", "interface", "info", "medium", True, "runtime.axe-results-truncated"),
    ("runtime.performance-metrics-unavailable", "site", "speed", "info", "medium", True, "runtime.performance-metrics-unavailable"),
    ("runtime.slow-lcp", "site", "speed", "medium", "high", False, "runtime.slow-lcp"),
    ("runtime.lcp-needs-improvement", "site", "speed", "low", "high", False, "runtime.slow-lcp"),
    ("runtime.high-cls", "site", "speed", "medium", "high", False, "runtime.high-cls"),
    ("runtime.cls-needs-improvement", "site", "speed", "low", "high", False, "runtime.high-cls"),
    ("runtime.slow-ttfb", "site", "speed", "medium", "high", False, "runtime.slow-ttfb"),
    ("runtime.ttfb-needs-improvement", "site", "speed", "low", "high", False, "runtime.slow-ttfb"),
    ("runtime.slow-fcp", "site", "speed", "medium", "high", False, "runtime.slow-fcp"),
    ("runtime.fcp-needs-improvement", "site", "speed", "low", "high", False, "runtime.slow-fcp"),
    ("runtime.long-main-thread-tasks", "site", "speed", "medium", "high", False, "runtime.long-main-thread-tasks"),
    ("runtime.large-page-transfer", "site", "speed", "low", "medium", True, "runtime.large-page-transfer"),
    ("runtime.page-errors", "site", "events", "high", "high", False, "runtime.page-errors"),
    ("runtime.console-errors", "site", "events", "medium", "high", False, "runtime.console-errors"),
    ("runtime.request-failures", "site", "events", "low", "high", False, "runtime.request-failures"),
    ("runtime.remote-requests-blocked", "site", "events", "info", "medium", True, "runtime.remote-requests-blocked"),
    ("runtime.unmediated-egress-blocked", "site", "events", "info", "medium", True, "runtime.unmediated-egress-blocked"),
]
