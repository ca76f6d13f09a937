"""Small literal tables that both engines read as VALUES."""

SENTENCES = list(enumerate([
    "I live in Lisbon. My cat is small.", "My name is Ada", "I work at Initech; I drive a Volvo", "Please forget that", "password: hunter2secret",
    "How many tanks do I have?", "I really like green tea", "I am on the train", "Where did I park?", "I no longer eat fish", "Who is my dentist?",
    "When is the meeting?", "ok", "What is my current address?", "I joined Globex! It is fun", "Can you recommend a book?", "the api_key=abc123xyz is here",
    "I own two bikes", "I moved from Porto to Berlin. I moved from Porto to Berlin", "I use Neovim with a tmux setup", "I switched from Neovim to Zed",
    "My favorite color is green, my sister lives in Oslo, we have two dogs", "We went to Bhilai, India", "I always squash before merging",
    "I handle all our deployments", "I broke every build today", "My opinion is that it ships", "My build is failing", "Sou vegetariano", "Ich bin müde",
    "I am using Python at work", "I am running the tests", "I have a dentist appointment on Thursday", "We decided to ship on Friday. Remind me to call Ana.",
    "User prefers dark mode, every time", "Actually I meant the blue one", "The standup is at nine every day", "token = ghp_abcdefghijklmnopqrstuvwx is my key, remind me later",
    "Ada works at Initech and Bo uses Spark", "Nimbus was built long ago", "Ann created Orbit", "that was wrong", "I was never in Rome", "4111 1111 1111 1111",
    "123-45-6789", "postgres://u:pw@host/db", "How long did it take to paint?", "Which do you prefer?", "What is the name of the lake?", "Did I ever mention a dog?",
    "What changed before and after?", "How much did I spend in total?", "I left Nimbus Data and joined Stripe", "My dentist's phone is 555-0100",
], 1))
STRUCTURED = [
    (1, "user", "owns", "Tank A", 1, "tanks", "2023-01-05"), (2, "user", "owns", "tank  a", 4, "tanks", "2023-02-05"), (3, "user", "owns", "Tank B", 1, "", "2022-05-01"),
    (4, "user", "played", "Game X", 40, "hours", "2023-03-01"), (5, "user", "played", "Game Y", 60, "hours", "2021-03-01"), (6, "user", "played", "Game Z", 40, "hours", None),
    (7, "user", "sent", "Postcards", 25, "postcards", "2022-01-01"), (8, "ann", "owns", "Bike", 1, "", "2024-01-01"),
]
VOTES = [(1, 1, "Paris"), (1, 2, "paris "), (1, 3, "Rome"), (2, 1, ""), (2, 2, "x"), (3, 1, ""), (3, 2, " "), (4, 1, "b"), (4, 2, "a"), (5, 1, "Z"), (5, 2, "y"), (5, 3, "y")]
ANSWERS = [(1, "Paris", "Paris"), (2, "paris", "Paris"), (3, "It was Paris", "paris"), (4, "red green blue big", "blue green red big cat"), (5, "no", "yes"), (6, "", "x")]


def values(rows) -> str:
    def one(v) -> str:
        return "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"
