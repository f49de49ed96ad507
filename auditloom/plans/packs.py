"""Rule packs of programming languages as data. Ids, patterns, severities and confidences; braces that Java reads as a count are escaped."""

from __future__ import annotations

from auditloom.operators.packs import Pack, PackRule

C, H, M, L = "CRITICAL", "HIGH", "MEDIUM", "LOW"

PHP = [
    ("sql_injection_get", r"(?i)(?:mysql_query|mysqli_query|pg_query|sqlite_query|odbc_exec|PDO::query|->query|->exec)\s*\(\s*[^)]*\$(?:_GET|_POST|_REQUEST|_COOKIE)", C, 0.95),
    ("sql_injection_concat", r"(?i)(?:SELECT|INSERT|UPDATE|DELETE)\s+.*\.\s*\$(?:_GET|_POST|_REQUEST)", C, 0.90),
    ("sql_injection_like", r"""(?i)(?:mysql_query|mysqli_query|->query)\s*\(\s*['"`].*\$[a-zA-Z_]+.*['"`]\s*\)""", C, 0.85),
    ("xss_echo", r"(?i)echo\s+\$(?:_GET|_POST|_REQUEST|_SERVER\[)", H, 0.80),
    ("xss_print", r"(?i)print\s+\$(?:_GET|_POST|_REQUEST)\b(?!.*htmlspecialchars)", H, 0.80),
    ("xss_no_escape", r"(?i)<\?(?:php|=)\s*\$(?:_GET|_POST|_REQUEST)\s*\?>", H, 0.85),
    ("lfi_include", r"(?i)(?:include|require|include_once|require_once)\s*\(?\s*\$_(?:GET|POST|REQUEST)", C, 0.95),
    ("lfi_include_file", r"""(?i)(?:include|require)\s*\(?\s*['"`].*\.\s*\$""", H, 0.80),
    ("command_injection_exec", r"(?i)(?:exec|system|passthru|shell_exec|popen|proc_open|pcntl_exec)\s*\(.*\$_(?:GET|POST|REQUEST)", C, 0.95),
    ("command_injection_backtick", r"`.*\$_(?:GET|POST|REQUEST)[^`]*`", C, 0.90),
    ("unserialize_user_input", r"(?i)unserialize\s*\(\s*\$(?:_GET|_POST|_REQUEST|_COOKIE)", C, 0.95),
    ("eval_user_input", r"(?i)eval\s*\(\s*\$(?:_GET|_POST|_REQUEST|_COOKIE)", C, 0.98),
    ("eval_dynamic", r"""(?i)eval\s*\(\s*['"`].*\.['"`]?\s*\.\s*\$""", H, 0.85),
    ("hardcoded_password", r"""(?i)\$(?:db_pass(?:word)?|passwd|password|secret|api_key|token)\s*=\s*['"][^'"]{4,}['"]""", C, 0.90),
    ("hardcoded_dsn", r"(?i)(?:mysql:|pgsql:|mongodb:).{0,30}://[^:]+:[^@]+@", H, 0.85),
    ("session_fixation", r"(?i)session_start\s*\(\s*\)\s*;(?!.*session_regenerate_id)", M, 0.60),
    ("cookie_no_httponly", r"(?i)setcookie\s*\([^)]*(?!.*httponly.*true)", L, 0.50),
    ("error_reporting_prod", r"""(?i)(?:error_reporting\s*\(\s*(?:E_ALL|0\b)\)|ini_set\s*\(\s*['"]display_errors['"]\s*,\s*['"]?(?:On|1|true)['"]?\s*\))""", M, 0.60),
    ("weak_hash_password", r"(?i)(?:md5|sha1)\s*\(\s*\$(?:password|pass|pwd|passwd)", H, 0.80),
    ("weak_hash", r"(?i)(?:md5|sha1)\s*\(\s*\$", L, 0.30),
    ("open_redirect", r"""(?i)header\s*\(\s*['"]Location:\s*['"]\s*\.\s*\$(?:_GET|_POST|_REQUEST)""", H, 0.80),
    ("ssrf_curl", r"(?i)(?:curl_setopt|curl_exec)\s*\([^)]*\$(?:_GET|_POST|_REQUEST)", H, 0.75),
    ("ssrf_file_get_contents", r"(?i)file_get_contents\s*\(\s*\$(?:_GET|_POST|_REQUEST)", H, 0.80),
    ("disable_functions_bypass", r"""(?i)(?:dl\s*\(|ini_restore\s*\(|putenv\s*\(\s*['"]LD_PRELOAD)""", M, 0.55),
]

NODE = [
    ("prototype_pollution_proto", r"""(?:obj|target|dest|data)\[["']__proto__["']\]\s*=""", C, 0.95),
    ("prototype_pollution_constructor", r"(?:obj|target|dest|data)\.constructor\.prototype\s*=", C, 0.95),
    ("prototype_pollution_merge", r"(?i)(?:\.extend|\.merge|\.assign|Object\.assign)\s*\([^)]*req\.(?:body|query|params)", C, 0.90),
    ("eval_user_input", r"(?:eval|new\s+Function)\s*\(\s*(?:req\.(?:body|query|params|headers|cookies)|request\.(?:body|query|params)|ctx\.request\.(?:body|query)|process\.argv|location\.(?:hash|search)|document\.cookie|URLSearchParams|localStorage\.\w+|window\.name|postMessage|fs\.(?:readFile|readFileSync))", C, 0.98),
    ("command_injection_exec", r"(?:exec|execSync|spawn|spawnSync)\s*\(\s*[^)]*(?:req\.(?:body|query|params)|process\.argv)", C, 0.95),
    ("command_injection_shell", r"(?:exec|execSync)\s*\([^,]*,[^{]*\{[^}]*shell\s*:\s*true", H, 0.80),
    ("path_traversal", r"path\.(?:join|resolve)\s*\([^)]*req\.(?:body|query|params)", H, 0.85),
    ("path_traversal_fs", r"(?:readFileSync|readFile|createReadStream|createWriteStream)\s*\(\s*[^)]*req\.", H, 0.80),
    ("ssrf_fetch", r"(?:fetch|axios|request|got|superagent)\s*\(\s*req\.(?:body|query|params)", H, 0.85),
    ("ssrf_http", r"(?:http\.get|http\.request|https\.get|https\.request)\s*\(\s*req\.", H, 0.80),
    ("nosql_injection_where", r"\$(?:where|regex|ne|gt|lt|in|nin)\s*:", H, 0.70),
    ("nosql_injection_user_input", r"(?:\.find|\.findOne|\.update|\.deleteOne)\s*\(\s*req\.(?:body|query)", H, 0.75),
    ("jwt_none_algorithm", r"""(?i)algorithm\s*:\s*["']none["']""", C, 0.95),
    ("jwt_hardcoded_secret", r"""(?i)(?:jwt\.sign|jwt\.verify)\s*\([^)]*["'][A-Za-z0-9_-]{20,}["']""", H, 0.80),
    ("dangerously_set_html", r"""dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:\s*(?!\s*['"`])""", M, 0.60),
    ("hardcoded_api_key", r"""(?i)(?:apiKey|api_key|apiSecret|api_secret|secretKey|secret_key)\s*[:=]\s*["'][A-Za-z0-9_-]{16,}["']""", C, 0.85),
    ("hardcoded_token", r"""(?i)(?:token|authToken|accessToken)\s*[:=]\s*["'](?:ghp_|gho_|github_pat_|sk-)[A-Za-z0-9]{20,}["']""", C, 0.90),
    ("require_user_input", r"require\s*\(\s*req\.(?:body|query|params)", C, 0.90),
    ("insecure_deserialization", r"(?i)(?:serialize\.unserialize|js-yaml\.load|yaml\.load)\s*\(", H, 0.75),
    ("redos", r"(?:\.test|\.match|\.exec|\.replace)\s*\(\s*new\s+RegExp\s*\(\s*", L, 0.40),
    ("npm_lifecycle_script", r'"(?:preinstall|postinstall|install)"\s*:\s*"(?:node|sh|bash|curl|wget)', C, 0.90),
]

PYTHON = [
    ("pickle_rce", r"(?i)pickle\.(?:loads?|load)\s*\(\s*(?:request\.(?:data|form|args|json)|input\b)", C, 0.98),
    ("pickle_load_any", r"""(?i)pickle\.(?:loads?|load)\s*\(\s*(?!open\s*\(|["'])""", H, 0.70),
    ("eval_user_input", r"(?i)eval\s*\(\s*(?:request\.(?:args|form|json|data)|input\s*\()", C, 0.95),
    ("exec_user_input", r"(?i)exec\s*\(\s*(?:request\.(?:args|form|json|data)|input\s*\()", C, 0.95),
    ("ssti_render_template_string", r"""(?i)render_template_string\s*\(\s*(?:request\.(?:args|form|json|data)|f["'])""", C, 0.90),
    ("ssti_format_string", r"(?i)\.format\s*\(.*request\.(?:args|form|json|data)", H, 0.70),
    ("command_injection_os", r"""(?i)os\.(?:system|popen)\s*\(\s*(?:request\.(?:args|form|json|data)|f["'])""", C, 0.95),
    ("command_injection_subprocess", r"(?i)subprocess\.(?:call|run|Popen|check_output)\s*\([^)]*(?:request\.|input\s*\()", C, 0.95),
    ("command_injection_shell_true", r"(?i)subprocess\.(?:call|run|Popen|check_output)\s*\([^)]*shell\s*=\s*True", M, 0.80),
    ("yaml_unsafe_load", r"(?i)yaml\.load\s*\(\s*(?!.*Loader\s*=\s*(?:yaml\.)?(?:Safe|Base|Full)Loader)(?!.*,\s*[A-Za-z_]\w*\s*\))", H, 0.80),
    ("yaml_full_load", r"(?i)yaml\.(?:full_load|unsafe_load|load_all)\s*\(", C, 0.85),
    ("hardcoded_password", r"""(?i)(?:password|passwd|pass|pwd|secret)\s*[:=]\s*["'][^"']{3,}["']""", H, 0.70),
    ("hardcoded_api_key", r"""(?i)(?:API_KEY|api_key|api_key|SECRET_KEY)\s*=\s*["'][A-Za-z0-9_-]{16,}["']""", H, 0.70),
    ("hardcoded_token", r"""(?i)(?:token|auth_token|access_token)\s*=\s*["'](?:sk-|ghp_|gho_)[A-Za-z0-9]{20,}["']""", C, 0.92),
    ("path_traversal_open", r"""(?i)(?:open|file)\s*\(\s*(?:os\.path\.join|f["']).*(?:request\.|input)""", H, 0.80),
    ("path_traversal_join", r"(?i)os\.path\.join\s*\([^)]*(?:request\.(?:args|form|json|data)|input\s*\(|sys\.argv)", H, 0.70),
    ("path_traversal_send_file", r"(?i)send_file\s*\(\s*[a-zA-Z_]\w*\s*\)", H, 0.65),
    ("sql_injection_format", r"""(?i)(?:\.execute|\.executemany)\s*\(\s*f["'].*(?:request\.|input)""", C, 0.90),
    ("sql_injection_percent", r"""(?i)(?:\.execute|cursor\.execute)\s*\(\s*["'].*%\s*(?:request\.|input\b)""", C, 0.85),
    ("insecure_tempfile", r"tempfile\.mktemp\s*\(", M, 0.60),
    ("debug_true", r"(?i)(?:DEBUG|debug)\s*=\s*True", M, 0.55),
    ("xxe_lxml", r"(?i)(?:etree\.parse|etree\.fromstring|etree\.XML)\s*\(", M, 0.50),
    ("xxe_sax", r"(?i)feature_external_(?:ges|entities)\s*[,\s]+True", H, 0.85),
    ("marshal_rce", r"(?i)marshal\.loads?\s*\(\s*(?:request\.|input)", C, 0.91),
]

GO = [
    ("ssti_template", r"(?i)(?:template\.Must|template\.New|tmpl\.Execute)\s*\(", H, 0.60),
    ("ssti_html_template", r"(?i)html/template.*\.Execute\s*\([^)]*(?:r\.(?:FormValue|PostFormValue|URL\.Query))", C, 0.85),
    ("sql_injection_fmt", r"""(?i)fmt\.Sprintf\s*\(\s*["'].*(?:SELECT|INSERT|UPDATE|DELETE).*["']""", H, 0.70),
    ("sql_injection_concat", r"""(?i)(?:db\.Query|db\.Exec|db\.QueryRow)\s*\(\s*["'].*%[svq].*['"]""", C, 0.85),
    ("command_injection_exec", r"(?i)exec\.Command\s*\(\s*[^)]*(?:r\.(?:FormValue|PostFormValue|URL\.Query)|os\.Args)", C, 0.95),
    ("command_injection_bash", r"""(?i)exec\.Command\s*\(\s*["'](?:bash|sh|zsh)["']""", H, 0.75),
    ("hardcoded_password", r"""(?i)(?:password|passwd|pwd|secret)\s*[:=]\s*["'][^"']{8,}["']""", H, 0.70),
    ("hardcoded_api_key", r"""(?i)(?:ApiKey|API_KEY|apiKey|api_key|SecretKey|SECRET_KEY)\s*=\s*["'][A-Za-z0-9_-]{16,}["']""", C, 0.90),
    ("hardcoded_jwt_secret", r"""(?i)(?:jwtSecret|JWT_SECRET|jwt_secret|signingKey)\s*=\s*["']""", H, 0.80),
    ("weak_crypto_md5", r"(?i)(?:md5\.New|md5\.Sum|crypto/md5)", H, 0.70),
    ("weak_crypto_sha1", r"(?i)(?:sha1\.New|sha1\.Sum|crypto/sha1)", L, 0.40),
    ("weak_crypto_des", r"(?i)crypto/des", M, 0.50),
    ("tls_skip_verify", r"InsecureSkipVerify\s*:\s*true", L, 0.40),
    ("ssrf_http_get", r"(?i)http\.Get\s*\(\s*[^)]*(?:r\.(?:FormValue|PostFormValue|URL\.Query)|fmt\.Sprintf)", H, 0.85),
    ("ssrf_http_client", r"(?i)(?:http\.Client|http\.NewRequest).{0,100}(?:r\.(?:FormValue|URL\.Query))", H, 0.80),
    ("path_traversal", r"(?i)(?:os\.Open|ioutil\.ReadFile|os\.ReadFile)\s*\([^)]*filepath\.Join", L, 0.40),
    ("pprof_exposed", r"(?i)net/http/pprof", M, 0.55),
    ("unsafe_pointer", r"unsafe\.Pointer\s*\(", L, 0.40),
    ("gorm_raw_sql", r"(?i)\.Raw\s*\(\s*[^)]*(?:r\.(?:FormValue|PostFormValue)|fmt\.Sprintf)", C, 0.80),
]

RUBY = [
    ("yaml_load", r"(?i)YAML\.load\s*\(\s*(?!.*safe_load)", C, 0.90),
    ("yaml_unsafe", r"(?i)(?:YAML\.unsafe_load|Psych\.load|YAML\.load_file)\s*\(", C, 0.90),
    ("mass_assignment_permit_all", r"(?i)(?:\.permit!|params\.permit\s*\(\s*\)\s*(?!.*require))", H, 0.75),
    ("ssti_erb", r"(?i)ERB\.new\s*\(\s*[^)]*\#\{", C, 0.90),
    ("ssti_erb_user_input", r"(?i)ERB\.new\s*\(\s*params\[", C, 0.95),
    ("command_injection_system", r"(?i)(?:system|exec|spawn)\s*\(\s*[^)]*params\[", C, 0.95),
    ("command_injection_backtick", r"`[^`]*\#\{[^\}]*params\[[^\}]*\}[^`]*`", C, 0.90),
    ("command_injection_io", r"(?i)IO\.popen\s*\(\s*[^)]*params\[", C, 0.90),
    ("sql_injection_where", r"""(?i)\.where\s*\(\s*["'].*\#\{""", C, 0.85),
    ("sql_injection_find_by_sql", r"""(?i)(?:find_by_sql|execute|select_all|select_rows)\s*\(\s*["'].*\#\{""", C, 0.90),
    ("hardcoded_secret_key_base", r"""(?i)secret_key_base\s*[:=]\s*["'][A-Za-z0-9]{20,}["']""", C, 0.92),
    ("hardcoded_password", r"""(?i)(?:password|passwd|pass|pwd)\s*[:=]\s*["'][^"']{3,}["']""", C, 0.85),
    ("hardcoded_api_key", r"""(?i)(?:api_key|API_KEY|api_secret|API_SECRET)\s*=\s*["'][A-Za-z0-9_-]{16,}["']""", C, 0.90),
    ("open_redirect", r"(?i)redirect_to\s+params\[", H, 0.80),
    ("marshal_load", r"(?i)Marshal\.load\s*\(\s*(?:params|request|cookies)", C, 0.90),
    ("eval_user_input", r"(?i)eval\s*\(\s*params\[", C, 0.95),
    ("dangerous_send", r"(?i)\.send\s*\(\s*params\[", H, 0.75),
    ("ssrf_open_uri", r"(?i)(?:open|URI\.open|open-uri)\s*\(\s*params\[", H, 0.80),
    ("ssrf_net_http", r"(?i)Net::HTTP\.(?:get|post|get_response)\s*\([^)]*params\[", H, 0.80),
    ("file_disclosure_send_file", r"(?i)send_file\s+params\[", H, 0.80),
    ("session_secret_weak", r"(?i)Rails\.application\.config\.secret_key_base", L, 0.40),
    ("regex_dos", r"(?i)\.(?:match|match\?|=~)\s*\/.*[\+\*]{2,}.*\/", L, 0.40),
]

# (extensions, rules): rule id, severity, title, pattern.
MULTI = [
    ((".go",), [
        ("GS001", C, "Hardcoded secret in Go", r"""(?:apiKey|api_key|API_KEY|secretKey|secret_key|SECRET_KEY|token|password)\s*[:=]\s*["'][^\s"']{8,}["']"""),
        ("GS002", H, "Missing env var fallback check", r'os\.Getenv\("([^"]+)"\)\s*==\s*""'),
        ("GS005", C, "SQL injection via fmt.Sprintf in Go", r"db\.(?:Query|Exec|QueryRow)\(\s*fmt\.Sprintf"),
        ("GS005", C, "SQL injection via string concat in Go", r'db\.(?:Query|Exec|QueryRow)\(\s*"[^"]*"\+'),
        ("GS004", C, "Command injection in Go", r'os\.Exec|exec\.Command\(\s*"[^"]*"\+|exec\.Command\(\s*fmt\.Sprintf'),
        ("GS002", H, "Weak crypto in Go", r'crypto/md5|"crypto/sha1"'),
        ("GS015", M, "Insecure random in Go (use crypto/rand)", r"math/rand[^/]"),
    ]),
    ((".ts", ".tsx", ".js", ".jsx", ".mjs"), [
        ("GS001", C, "Hardcoded secret in TypeScript", r"""(?:apiKey|api_key|API_KEY|secretKey|secret_key|SECRET_KEY|token|password)\s*[:=]\s*["'`][^\s"'`]{8,}["'`]"""),
        ("GS001", H, "Hardcoded secret assigned to env in TS", r"""process\.env\.\w+\s*=\s*["'`][^\s"'`]{8,}["'`]"""),
        ("GS036-eval_dynamic", H, "Dynamic code execution in TS", r"eval\(|new Function\("),
        ("GS020", C, "XSS via innerHTML/dangerouslySetInnerHTML", r"document\.write\(|innerHTML\s*=|dangerouslySetInnerHTML"),
        ("GS004", C, "Command injection in Node.js", r"child_process\.exec\(|\.execSync\("),
        ("GS005", C, "SQL injection via template literal", r"""(?:\.query|\.execute)\(\s*["'`].*\$\{"""),
        ("GS018", H, "SSL verification disabled in TS", r"ssl:\s*\{\s*rejectUnauthorized:\s*false"),
        ("GS019", M, "Permissive CORS in TS", r"""cors:\s*\{\s*origin:\s*["']\*["']"""),
    ]),
    ((".rs",), [
        ("GS001", C, "Hardcoded secret in Rust", r"""(?:api_key|API_KEY|secret_key|SECRET_KEY|token|password)\s*[:=]\s*["'][^\s"']{8,}["']"""),
        ("GS004", H, "Unsafe block in Rust", r"unsafe\s*\{"),
        ("GS004", C, "Command injection in Rust", r"std::process::Command::new\([^)]*\+"),
        ("GS005", C, "SQL injection via format! in Rust", r"\.execute\(\s*format!"),
        ("GS002", H, "Weak crypto in Rust", r"extern\s+crate\s+md5|extern\s+crate\s+sha1"),
        ("GS015", M, "Non-cryptographic RNG in Rust", r"rand::thread_rng\(\)"),
    ]),
    ((".java",), [
        ("GS001", C, "Hardcoded secret in Java", r'(?:apiKey|api_key|API_KEY|secretKey|secret_key|SECRET_KEY|token|password)\s*=\s*"[^\s"]{8,}"'),
        ("GS005", C, "SQL injection via string concat in Java", r'Statement.*\.execute(?:Query|Update)?\(\s*"[^"]*"\s*\+'),
        ("GS005", C, "SQL injection in Java Statement", r'\.createStatement\(\)\.execute\(\s*"[^"]*"\s*\+'),
        ("GS004", C, "Command injection in Java", r"Runtime\.getRuntime\(\)\.exec\("),
        ("GS004", H, "Command injection via ProcessBuilder", r"ProcessBuilder\([^)]*\+"),
        ("GS046", C, "Unsafe deserialization in Java", r"ObjectInputStream|readObject\(\)|readUnshared\(\)"),
        ("GS019", H, "Permissive security config in Java", r"\.disable\(\)|\.all\(\)|\.anonymous\(\)"),
    ]),
]

ACTIONS = [
    ("pr_target_checkout_head", r"""pull_request_target[\s\S]{0,1500}?ref:\s*["']?\s*\$\{\{?\s*github\.(?:head_ref|head_sha|event\.pull_request\.head\.(?:sha|ref))""", C, 0.92),
    ("workflow_run_untrusted_checkout", r"""workflow_run[\s\S]{0,1500}?actions/checkout@[\s\S]{0,200}?ref:\s*["']?\s*\$\{\{?\s*github\.event\.workflow_run\.head_""", H, 0.75),
    ("hardcoded_env_secret", r"""(?i)^\s{2,}(?:aws_access_key_id|aws_secret_access_key|db_password|github_token|private_key|password|passwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret)\s*:\s*(?!\s*["']?\s*\$)\s*["']?[^"'\n\r$]{8,}["']?\s*$""", H, 0.80),
]
PERMISSIONS = PackRule("GS045-missing_permissions", "GitHub Actions workflow without permissions block (least-privilege)", H, 0.75, r"^permissions\s*:")

#: Paths that the packs of single languages leave out.
EXCLUDED = r"(?i)(?:^|/)(?:tests?|fixtures?|examples?|mock|__mocks__|node_modules|vendor|\.git|venv|\.venv|\.pytest_cache|__pycache__|dist|build)(?:/|$)"
EXCLUDED_PHP = r"(?i)(?:^|/)(?:tests?|fixtures?|examples?|mock|__mocks__|node_modules|vendor|\.git|venv|\.venv|\.pytest_cache|__pycache__|dist|build|wp-content/(?:plugins|themes)/[^/]+/(?:tests?|vendor))(?:/|$)"


def _pack(name: str, base: str, title: str, extensions: tuple[str, ...], rules: list[tuple], excluded: str, **options) -> Pack:
    return Pack(name, extensions, [PackRule(f"{base}-{i}", f"{title}: {i}", severity, confidence, p) for i, p, severity, confidence in rules], excluded, **options)


PACKS = [
    _pack("php", "GS035", "PHP security", (".php", ".phtml", ".php3", ".php4", ".php5", ".pht", ".phps", ".inc"), PHP, EXCLUDED_PHP),
    _pack("node", "GS036", "Node.js security", (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"), NODE, EXCLUDED),
    _pack("python", "GS037", "Python security", (".py",), PYTHON, EXCLUDED, docstrings=False, many=PackRule("GS037-high_risk", "Python file has many security issues", "INFO", 0.40, "")),
    _pack("go", "GS038", "Go security", (".go",), GO, EXCLUDED),
    _pack("ruby", "GS039", "Ruby security", (".rb",), RUBY, EXCLUDED),
    _pack("actions", "GS045", "GitHub Actions", (), ACTIONS, "", path=r"(?i)\.github/workflows/.*\.ya?ml$", required=(PERMISSIONS,)),
    *[Pack(f"multi{ext[0]}", ext, [PackRule(i, title, severity, None, p) for i, severity, title, p in rules], window=None) for ext, rules in MULTI],
]
