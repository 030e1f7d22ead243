import base64
import json
import random
import string

import pytest

from threadloom.llm import secrets as sc

RNG = random.Random(5)


def alnum(n, extra=""):
    return "".join(RNG.choice(string.ascii_letters + string.digits + extra) for _ in range(n))


def hexes(n):
    return "".join(RNG.choice("0123456789abcdef") for _ in range(n))


def password():
    return "".join(RNG.choice(["Kilo", "Tora", "Venu", "Salo"]) for _ in range(2)) + str(RNG.randrange(100, 9999)) + RNG.choice("!#%^*~+_") + alnum(3)


def pem(kind):
    return f"-----BEGIN {kind}-----\n" + "\n".join(alnum(64, "+/") for _ in range(4)) + f"\n-----END {kind}-----"


SECRET = [
    lambda: f"aws_secret_access_key = {alnum(39, '+/')}7", lambda: f"id = AKIA{alnum(16).upper()}", lambda: f'KEY="sk-{alnum(40)}"', lambda: f"GH=github_pat_{alnum(50)}", lambda: f"https://bot:gho_{alnum(36)}@host.invalid/x.git",
    lambda: f"curl -H 'Authorization: Bearer {alnum(32, '._-')}1a' https://x.invalid", lambda: "Authorization: Basic " + base64.b64encode(f"user:{password()}".encode()).decode(), lambda: f"Set-Cookie: sid={alnum(40)}; Path=/", lambda: f'client_secret = "{alnum(36, "~_")}"',
    lambda: f"PGPASSWORD='{password()}' psql -h db", lambda: f"./deploy --host a --password={password()} --dry-run", lambda: f'{{"x": {{"dbPassword": "{password()}", "retries": 3}}}}', lambda: f"DATABASE_URL=postgres://meta:{alnum(13)}9@db.invalid:5432/x",
    lambda: f'os.environ.setdefault("APP_SECRET", "{hexes(32)}")', lambda: pem("RSA PRIVATE KEY"), lambda: f"  password: {password()}", lambda: f"By the way the staging password is {password()}, please don't share it.", lambda: f'client = connect("sk-{alnum(9)}"\n    + "{alnum(24)}")',
]
HARMLESS = [
    lambda: f"sha256:{hexes(64)}  x.tar.gz", lambda: f"commit {hexes(40)}", lambda: f"integrity sha512-{alnum(80, '+/')}==", lambda: f"ssh-ed25519 AAAAC3{alnum(60)} me@laptop", lambda: pem("CERTIFICATE"), lambda: pem("PUBLIC KEY"), lambda: f"img: data:image/png;base64,{alnum(120, '+/')}",
    lambda: "API_KEY=YOUR_API_KEY_HERE", lambda: "password: ********", lambda: 'secret = "xxxxxxxxxxxxxxxxxxxx"', lambda: "password: ${DB_PASSWORD}", lambda: 'token = os.environ["APP_TOKEN"]', lambda: "Authorization: Bearer [REDACTED:token]", lambda: "max_token_count: 6687",
    lambda: f"request_id: {hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: 'x = "kago-506"', lambda: "The password field must have 14 characters, and the token expires.", lambda: "sk-learn pipeline step, see cookie: enabled", lambda: "postgres://user:$DB_PASS@host:5432/x", lambda: "const x = load('abc', 6713);",
]
PROSE = [
    "After 8 runs the prompt in src/tokenizer_mo.ts was stale.",
    "def tora(x):\n    return x + 2526",
    "We traced it to mock_x() at 2025-09-01T10:00:00Z.",
]


def texts(makers, n):
    out = []
    for k in range(n):
        body = "\n".join([RNG.choice(PROSE), makers[k % len(makers)](), RNG.choice(PROSE)])
        out.append(
            ("content", body) if k % 2 else ("raw_json", json.dumps({"uuid": f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", "message": {"content": body}})),
        )
    return out


@pytest.fixture(scope="module")
def model():
    return sc.train(texts(SECRET, 540) + texts(HARMLESS, 1200))


def test_held_out_accuracy(model):
    good, bad = texts(SECRET, 360), texts(HARMLESS, 400)
    hit = sc.find([t for _, t in good], [f for f, _ in good], model)
    false = sc.find([t for _, t in bad], [f for f, _ in bad], model)
    assert sum(map(bool, hit)) >= 0.98 * len(good), [t for (_, t), h in zip(good, hit) if not h][:3]
    assert sum(map(bool, false)) <= 0.02 * len(bad), [(t, h) for (_, t), h in zip(bad, false) if h][:3]


def test_only_the_value_is_cut(model):
    value = password()
    text = f'{{"dbPassword": "{value}", "retries": 3}}'
    (spans,) = sc.find([text], ["content"], model)
    assert sc.cut(text, spans) == f'{{"dbPassword": "{sc.MARK}", "retries": 3}}'
    raw = json.dumps({"content": f"x\nPGPASSWORD='{value}' psql"})
    (spans,) = sc.find([raw], ["raw_json"], model)
    assert json.loads(sc.cut(raw, spans)) == {"content": f"x\nPGPASSWORD='{sc.MARK}' psql"}


def test_blanked_copies_keep_their_length():
    for t in ('a\\n\\"b\\\\nq', "plain", '\\u00e9\\/x', "\\\\\\\\"):
        assert len(sc.blank_escapes(t)) == len(t)


def test_null_empty_long_and_repeated(spark, model, monkeypatch):
    monkeypatch.setattr(sc, "train", lambda sample: model)
    secret = f"KEY=\"sk-{alnum(40)}\""
    rows = [
        (1, secret, None),
        (1, secret, None),
        (2, None, ""),
        (3, "", None),
        (4, "w " * 200_000 + secret, "harmless text"),
        (5, "nothing", secret),
    ]
    df = spark.createDataFrame(rows, "id bigint, content string, redacted string")
    got = sorted((r.row_id, r.field, r.n) for r in sc.scan([(df, "t", "id", {"content": "content", "raw_json": "redacted"})]).collect())
    assert got == [(1, "content", 1), (1, "content", 1), (4, "content", 1), (5, "raw_json", 1)]
    assert sc.scan([(df.limit(0), "t", "id", {"content": "content"})]).count() == 0


def test_no_training_data_still_finds_formats():
    model = sc.train([])
    (spans,) = sc.find([f"GH=github_pat_{alnum(50)}"], ["content"], model)
    assert spans


def test_sample_is_bounded(spark):
    df = spark.range(5000).selectExpr("id", "concat('text ', id) AS content")
    assert 0 < len(sc.sample_of(df, "id", {"content": "content"}, 500)) <= 563


#: Written by hand; the sample has no value like these.
ANNOUNCED = [
    ('password = "hunter2"', 'hunter2'),
    ('password: swordfish', 'swordfish'),
    ('DB_PASSWORD=correcthorsebatterystaple', 'correcthorsebatterystaple'),
    ('passwd=ab12cd', 'ab12cd'),
    ('export TOKEN="letmein2024"', 'letmein2024'),
    ('redis-cli -a s3cret7', 's3cret7'),
    ('password: swordfish99', 'swordfish99'),
    ('api_key = "abcdefghijklmnop"', 'abcdefghijklmnop'),
    ('{"password":"qwertyuiop"}', 'qwertyuiop'),
    ('pwd = "Tr0ub4dor&3"', 'Tr0ub4dor&3'),
    ("const dbPassword = 'moonlight';", 'moonlight'),
    ('mysql -u root -ptiger db', 'tiger'),
    ('mysqldump --password=Winter2023 shop', 'Winter2023'),
    ('curl -u admin:geheim https://x.invalid/api', 'geheim'),
    ('postgres://app:sunshine@db.invalid/app', 'sunshine'),
    ('amqp://svc:p@ss:w0rd@mq.invalid:5672/', 'p@ss:w0rd'),
    ('smtp_pass: k1tt3n', 'k1tt3n'),
    ('client_secret: zGk3-aa', 'zGk3-aa'),
    ('the root password is monkey77, rotate it', 'monkey77'),
    ('spring.datasource.password=dragonfly', 'dragonfly'),
    ('<add key="x" password="Baseball1" />', 'Baseball1'),
    ('GET /cb?access_token=ya29abcd&state=3', 'ya29abcd'),
    ('X-Api-Key: 9f8e7d6c5b4a', '9f8e7d6c5b4a'),
    ('Authorization: token 6fbc1d2e', '6fbc1d2e'),
    ('Cookie: session=abc123def456; theme=dark', 'abc123def456'),
    ('sshpass -p raspberry ssh pi@host', 'raspberry'),
    ('docker login -u me -p whale99 reg.invalid', 'whale99'),
    ('"refresh_token": "1//0gLkq"', '1//0gLkq'),
    ('ENV REDIS_PASSWORD=foobared', 'foobared'),
    ("SECRET_KEY = 'django-insecure-abc#1'", 'django-insecure-abc#1'),
    ('signing_key: 00112233', '00112233'),
    ('auth_token => "s.Ab3d"', 's.Ab3d'),
    ("ADMIN_PASS='letmein!'", 'letmein!'),
    ('passphrase: correct-horse-battery', 'correct-horse-battery'),
    ('--token=tk_9aa1 --verbose', 'tk_9aa1'),
    ('password=123456', '123456'),
    ('machine x login me password rosebud', 'rosebud'),
    ('ACCESS_KEY=minioadmin', 'minioadmin'),
]
NOT_LITERAL = [
    'password: ********',
    'password: ${DB_PASSWORD}',
    'token = os.environ["X"]',
    'password: required',
    'token: string',
    'cookie: enabled',
    'api_key: YOUR_API_KEY',
    'secret: null',
    'max_tokens: 4096',
    'token_count = 12',
    'the password is required for login',
    'password = getpass.getpass()',
    'secretKeyRef:\n  name: db-creds\n  key: password',
    'passwords must have 12 characters',
    'Authorization: Bearer <token>',
    'token: ""',
    'primary_key: id',
    'key: value',
    'const token = await getToken();',
    'password = input("Password: ")',
    'password_field = "Enter password"',
    'tokens: 5321',
    'cache_key = "user:42"',
    'public_key: ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAAIJq',
    'token: ***',
    'PASS: 12, FAIL: 0',
    'password: changeme',
    '"password": "<redacted>"',
    'secret = vault.read("kv/app")',
    'DATABASE_PASSWORD=$(cat /run/secrets/db)',
    'tokenizer: bpe-68',
    'password=%s',
    'passwd: files systemd',
    'keyboard: us',
    'sha256:ab12ab12ab12ab12ab12ab12ab12ab12ab12ab12ab12ab12ab12ab12ab12ab12',
    'commit 9fceb02d0ae598e95dc970b74767f19372d61af8',
]

#: Written by hand after the operator; their first misses led to fixes.
HELD_OUT = [
    ('DB_PASS: olympus', 'olympus'),
    ("password => 'gardenia'", 'gardenia'),
    ('export MYSQL_PWD=tulip9', 'tulip9'),
    ('{"apiKey": "k-77ab"}', 'k-77ab'),
    ('wifi passphrase is "blue-lagoon-42"', 'blue-lagoon-42'),
    ('ftp://backup:velvet@nas.invalid/', 'velvet'),
    ('--api-key 5d41402a', '5d41402a'),
    ('--db-password s3same', 's3same'),
    ("access_token: 'xyz.987'", 'xyz.987'),
    ('redis-cli -h cache.invalid -a Pepper!', 'Pepper!'),
    ('curl --user jo:sesame99 https://h.invalid', 'sesame99'),
    ('Set-Cookie: auth=deadbeef01; HttpOnly', 'deadbeef01'),
    ('authorization: Bearer abc123DEF', 'abc123DEF'),
    ('jdbc.password=lemonade', 'lemonade'),
    ('AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzzzKEY', 'wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzzzKEY'),
    ('webhook_secret: whsec_11', 'whsec_11'),
    ("os.environ['ADMIN_TOKEN'] = 'tok-5'", 'tok-5'),
    ('let password = "pa55,word";', 'pa55,word'),
    ('client_secret=GOCSPX-abc', 'GOCSPX-abc'),
    ('master_password: "open sesame"', 'open sesame'),
    ('login: bob password: builder7', 'builder7'),
    ('https://user:pa%24%24@h.invalid', 'pa%24%24'),
    ('pwd=Admin@123;database=x', 'Admin@123'),
    ('our token was 9f9f-ab, revoke it', '9f9f-ab'),
    ('config.set("jwt_secret", "shhh1")', 'shhh1'),
    ('the API key is AbC-123-xYz', 'AbC-123-xYz'),
    ('git clone https://oauth2:glft99@git.invalid/x.git', 'glft99'),
]
HELD_OUT_HARMLESS = [
    'password: {{ vault_db_password }}',
    '"password": {"type": "string"}',
    'token: null',
    'reset your password here',
    'password policy: strict',
    'The token is refreshed hourly',
    'secret = os.getenv("S")',
    'api_key=<API_KEY>',
    'apiKey: process.env.API_KEY',
    'password: !vault |',
    'tokens_used: 88',
    'token_type: bearer',
    'secret_name: db-main',
    'password_hash: $2b$12$abcdefghijk',
    'key: id',
    'bearer of news',
    'cookie policy updated',
    'pass: 3',
    'password = None',
    'credentials: include',
    'auth: basic',
    'login(user, password)',
    'def check(password: str) -> bool:',
    'password: Optional[str] = None',
    'type Password = string',
    'id_token_signed_response_alg: RS256',
    'sort_key: created_at',
    'etag: "33a64df551425fcc55e4d42a148795d9f25f89d4"',
    'version: 1.2.3-beta4',
    'trace_id=4bf92f3577b34da6a3ce929d0e0e4736',
]


@pytest.fixture(scope="module")
def own_model(spark):
    """Trained on the test tables as the queries do."""
    from threadloom.llm import queries

    sample = []
    for rows, _, row_id, fields, *path in queries._secret_tables(spark, "/root/testdata/sf0.01"):
        sample += sc.sample_of(rows, row_id, fields, sc.SAMPLE_ROWS // 2, *path)
    return sc.train(sorted(sample))


@pytest.mark.parametrize("around", ["{}", "After 8 runs the prompt in src/tok.ts was stale.\n{}\nmore"])
def test_hand_labelled_texts(own_model, around):
    """Literals in announced places are found whole, whatever they look like."""
    found = whole = wrong = 0
    cases, harmless = ANNOUNCED + HELD_OUT, NOT_LITERAL + HELD_OUT_HARMLESS
    for value, text in [(v, around.replace("{}", t)) for t, v in cases]:
        spans = sc.find([text], ["content"], own_model)[0]
        found += bool(spans)
        whole += value in [text[a:b] for a, b in spans]
    for text in harmless:
        wrong += bool(sc.find([around.replace("{}", text)], ["content"], own_model)[0])
    print(found, whole, wrong)
    assert found >= 0.95 * len(cases) and whole >= 0.95 * len(cases)
    assert wrong <= 0.05 * len(harmless)


def test_features_hold_no_label_rule():
    """A value of an issuer's format counts by its characters and place, not because a pattern knows it."""
    names = sc._names(sc.candidates("x = 'ghp_" + "a1B2" * 9 + "'")[0], "content", 0.0, "")
    assert not [n for n in names if "label" in n or "format" in n]
    assert len(names) <= sc.N_SLOTS


#: Written by hand at the end and run once; nothing was changed after it but that a header's scheme alone is no value.
UNSEEN = [
    ('MAIL_PASSWORD=paperclip', 'paperclip'),
    ('vault_token: hvs.q7', 'hvs.q7'),
    ('"db_pass": "t0mato"', 't0mato'),
    ('export STRIPE_SECRET="whatever9"', 'whatever9'),
    ('user_password: Juniper', 'Juniper'),
    ('mongodb://root:cactus@mongo.invalid/admin', 'cactus'),
    ('--admin-password=garden2', 'garden2'),
    ('curl -u ci:lantern https://ci.invalid/job', 'lantern'),
    ('mysql -h db -u app -pmarble shop', 'marble'),
    ('X-Auth-Token: 77af20', '77af20'),
    ("passphrase = 'two words'", 'two words'),
    ('rabbitmq_password => "carrot"', 'carrot'),
    ('Authorization: Bearer qwerty-0987', 'qwerty-0987'),
    ("SMTP_PWD: 'Pa;ss'", 'Pa;ss'),
    ('session_secret=kettle42', 'kettle42'),
    ('PRIVATE_KEY = "0xabc123"', '0xabc123'),
    ('redis-cli -p 6380 -a umbrella ping', 'umbrella'),
    ('the deploy token is dpl_Zz19', 'dpl_Zz19'),
    ('?password=ladder&user=1', 'ladder'),
    ('encryption_key: 4f4f4f', '4f4f4f'),
    ('kubectl create secret generic x --from-literal=password=violet8', 'violet8'),
    ('CONFLUENCE_API_TOKEN=ATATT3x', 'ATATT3x'),
    ("http_password='s p a c e'", 's p a c e'),
    ('NPM_TOKEN=npm_short1', 'npm_short1'),
]
UNSEEN_HARMLESS = [
    'password: string',
    'token: required',
    'secret: ${SECRET}',
    'apiKey: "YOUR-KEY"',
    'password = read_password()',
    'if password == "":',
    'token_limit = 4000',
    'pass = true',
    'the secret of success is work',
    'key: value pairs',
    'credentials: same-origin',
    'passwordHash: bcrypt',
    'access_token: null',
    'password: xxxxxxxx',
    'tokens: [1, 2, 3]',
    'secret_manager: aws',
    'Authorization: Basic',
    'cookie: none',
    'assert token is not None',
    'bearer_format: JWT',
    'password1 and password2 must match',
    'set password to the new value',
    'key=lambda x: x.name',
    'api_key: str = ""',
]


def test_texts_that_nothing_was_mended_after(own_model):
    hit = [v in [t[a:b] for a, b in sc.find([t], ["content"], own_model)[0]] for t, v in UNSEEN]
    wrong = [t for t in UNSEEN_HARMLESS if sc.find([t], ["content"], own_model)[0]]
    assert sum(hit) >= 0.9 * len(hit) and len(wrong) <= 2, (hit, wrong)
