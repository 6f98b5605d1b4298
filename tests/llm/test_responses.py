import random

from marram.llm import responses as R
from marram.llm.languages import Languages


def test_lcs_against_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        got = R.lcs(a, b)
        assert len(got) == t[-1][-1]
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


ANSWERS = {
    None: "empty", "": "empty", " ​\n": "empty", "N/A": "empty", "**": "empty", "```\n```": "empty", "Answer:": "empty", "<br>": "empty",
    "Which option controls the window of a reader?": "copy", "> which option controls the window of a reader": "copy", "Q: Which option controls the window of a reader? A: which option controls the window of a reader": "copy",
    "You asked: Which option controls the window of a reader?": "copy", "Which option controls the window of reader": "copy",
    "I'm sorry, but I can't help with questions on the window.": "refusal", "Unfortunately I was not given the relevant pages, so I have to pass. Feel free to ask me something else.": "refusal",
    "Désolé, je ne peux pas répondre à cela.": "refusal", "I don't know.": "refusal",
    "Die Abfrage wird von `A::b()` geprüft, bevor die leere Datei geladen wird.": "other_language", "Вызовите `A::b()`, чтобы не потерять запись.": "other_language",
    "The reader opens the window and returns an empty": "truncated", "Call this.\n```php\nfoo(": "truncated",
    "No.": None, "Yes, with `cache.ttl`.": None, "Sorry for the long reply. The reader opens the window.": None, "The excerpts do not mention it, but the rest is clear. Set `a.b` to 4.": None,
    "You asked: Which option controls the window of a reader? The option `cache.ttl` decides that.": None, 'The label was stored as "leere Datei der Abfrage". The reader opens the window.': None,
    "The reader opens the window.\n\n- empty list\n- `a.b` = 4": None, "Only during bootstrap.": None,
}
Q = "Which option controls the window of a reader?"


# refusals in words of their own, written apart from the templates
HELD_OUT = """I'm sorry, but I can't assist with that request.
As an AI language model, I don't have access to real-time data, so I can't answer this.
I'm afraid I don't have that information.
The provided context does not contain the answer.
This falls outside of what I am able to discuss.
I must refrain from commenting on that.
I don't feel comfortable answering this question.
It would be inappropriate for me to respond to that.
Sorry, I do not know.
I have no idea.
Unfortunately, the documents given do not cover this, so I am not able to help.
There isn't sufficient context for me to determine that.
I won't be answering that.
I'm not sure about that, please check the documentation.
We are unable to provide any details on this topic.
That question is beyond my scope.
I cannot confirm this from the sources.
My guidelines do not allow me to discuss it.
I lack the knowledge needed to reply.
Your request cannot be answered with the information at hand.
Ich kann Ihnen dabei leider nicht helfen.
Dazu liegen mir keine Informationen vor.
Das weiß ich leider nicht.
Der Kontext reicht nicht aus, um die Frage zu beantworten.
Je ne sais pas.
Je suis désolé, mais je ne suis pas en mesure de vous aider.
Le contexte ne suffit pas pour répondre à la question.
Lo siento, pero no puedo ayudarle con eso.
No tengo suficiente información para responder.
No lo sé.
Извините, я не знаю ответа.
У меня недостаточно информации, чтобы ответить.
К сожалению, я не могу помочь с этим вопросом.
对不起，我不知道。
抱歉，我无法提供帮助。
根据提供的资料，无法回答该问题。""".split("\n")
ANSWERING = """No, that option was removed and does nothing now.
The handler cannot respond to requests after shutdown.
You cannot open the window without a token.
It is not possible to pass null here; use an empty list.
The context does not contain a session id until `start()` is called.
I would use `Cache::get()` for that.
Yes, we support it since version 4.
Without a valid response the client retries up to three times.
The question of ordering does not matter because the set is sorted.
I can't see your full setup; still, this should work. Set `ttl` to 5.
If the help page is missing, check the documentation folder.
Access is denied when no policy is given.
The data source returns no details when the table is empty.
Unfortunately the old API was removed; call `boot()` with the new options instead.""".split("\n")


def test_refusals_of_their_own_words():
    f = R.Refusals()
    assert sum(map(f, HELD_OUT)) >= 0.9 * len(HELD_OUT)
    assert not [a for a in ANSWERING if f(a)]


def test_copies_of_any_length():
    q = "which option controls the window of a reader".split()
    assert R.is_copy(q, q * 40) and R.is_copy(q, ("you asked".split() + q) * 9)
    assert not R.is_copy(q, q * 40 + "it is the cache".split()) and not R.is_copy(q, q[:3]) and not R.is_copy(q, ["x"] * 100000)


def test_language():
    best = Languages().best
    for want, text in (
        ("en", "The window is open and the reader waits for it"), ("de", "Wie kann ich die Datei laden, wenn sie nicht da ist"), ("fr", "Comment faut-il charger le fichier quand il manque"), ("es", "Cómo puedo cargar el archivo cuando falta"),
        ("it", "Come posso caricare il file quando manca la chiave"), ("pt", "Como posso carregar o arquivo quando falta a chave"), ("nl", "Hoe kan ik het bestand laden als de sleutel ontbreekt"), ("ru", "Как загрузить файл, если его нет"), ("uk", "Як завантажити файл, якщо його немає"), ("zh", "如何加载文件"), ("ja", "ファイルを読み込む方法"),
    ):
        assert best(text) == want, text
    assert best("12 ...") is None
    assert R.prose("`a b` $x foo::bar a_b \"quoted words\"") == []


def test_frame(spark):
    results = [(i, f"q{i % 3}" if i % 5 else "q0", a, "clash") for i, a in enumerate(ANSWERS)] + [(100 + i, None if i % 2 else "unknown", a, "z") for i, a in enumerate(("", "No."))]
    results += [(1000 + i, "q0", "The reader opens the window and returns an empty list.", "x") for i in range(200)]
    r = spark.createDataFrame(results, "result_id long, question_id string, answer string, question string")
    q = spark.createDataFrame([(f"q{i}", Q, "x") for i in range(3)] * 2 + [(None, Q, "x"), ("q9", None, "x")], "id string, question string, answer string")
    joined = R.with_question(r, q, hot_share=4)
    assert joined.count() == len(results)
    got = {x["result_id"]: x["defect"] for x in R.defects(r, q).collect()}
    want = {i: k for i, (a, k) in enumerate(ANSWERS.items()) if k} | {100: "empty"}
    assert got == want
    assert R.defects(r.limit(0), q).collect() == [] and R.defects(r, q.limit(0)).count() > 0
