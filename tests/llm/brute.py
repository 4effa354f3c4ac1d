"""Plain versions of the operators, in memory, for tests."""

import collections
import hashlib
import re

from addrloom.llm import line_templates, quality, tool_calls

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORDS.findall(text or "")


def covered(texts, least):
    """Per text, the places of words in a window that starts anywhere else too."""
    split = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + least]) for w in split for i in range(len(w) - least + 1))
    return [
        {j for i in range(len(w) - least + 1) if seen[tuple(w[i : i + least])] > 1 for j in range(i, i + least)}
        for w in split
    ]


def removed(texts, least):
    """(number of words, number of removed ones, hash of what is kept) of each text."""
    out = []
    for text, hit in zip(texts, covered(texts, least)):
        kept = " ".join(x for i, x in enumerate(words(text)) if i not in hit)
        out.append((len(words(text)), len(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def components(texts, k, percent):
    """(sets of shingles, a root for each text); only texts with shingles link."""
    sets = []
    for t in texts:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(
            {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        )
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    return sets, [top(i) for i in range(len(texts))]


def measures(text):
    w, t = words(text), text or ""
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(
            re.findall(r"[#*$%&|<>]", t)
        ), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "n_lines": len(lines), "n_upper_words": min(
            len(w), sum(x.isupper() for x in t.split())
        ), "n_table_words": w.count("|"), "n_distinct_words": len(set(w)),
    }


def passes(text, policy):
    m = measures(text)
    return not any(eval(quality.RULES[r], {}, m) for r in quality.POLICIES[policy])


def seeds(forms):
    """Line to its seed, of (line, documents) of one leaf, by comparing every line with every seed."""
    split = {f: f.split(" ") for f in forms}
    at = collections.Counter((i, x) for w in split.values() for i, x in enumerate(w))
    weight = {f: sum(at[x] for x in enumerate(w)) for f, w in split.items()}
    held, out = [], {}
    for f in sorted(forms, key=lambda f: (-weight[f], -forms[f], f)):
        far = [sum(a != b for a, b in zip(split[f], split[s])) for s in held]
        most = int(line_templates.VARIABLE_MOST * len(split[f]) + 1e-9)
        if far and min(far) <= most:
            out[f] = held[far.index(min(far))]
        else:
            held.append(f)
            out[f] = f
    return out


def without_lines(rows, documents, most=None):
    """Texts of (doc_id, text) rows without the lines whose template stands in enough documents, but for its first document."""
    parsed = {row: [line_templates.parse(x.encode()) for x in (row[1] or "").split("\n")] for row in rows}
    leaves = collections.defaultdict(lambda: collections.defaultdict(set))
    for row, lines in parsed.items():
        for leaf, _, form in filter(None, lines):
            leaves[leaf][form.decode()].add(row)
    template = {
        (leaf, f): (leaf, s) for leaf, forms in leaves.items() for f,
        s in seeds({f: len(d) for f, d in forms.items()}).items()
    }
    docs = collections.defaultdict(set)
    for (leaf, f), t in template.items():
        docs[t] |= leaves[leaf][f]
    first = {
        t: min(d, key=lambda r: (r[0] is not None, r[0]))[1] for t,
        d in docs.items() if len({r[1] for r in d}) >= documents
    }
    out = []
    for row in rows:
        if row[1] is None:
            out.append(None)
            continue
        keep = [p is None or first.get(template[p[0], p[2].decode()], row[1]) == row[1] for p in parsed[row]]
        lines = row[1].split("\n")
        left = [x for x, k in zip(lines, keep) if k]
        size = [sum(len(x.encode()) for x in xs) for xs in (left, lines)]
        out.append(row[1] if most is not None and size[0] < (1 - most) * size[1] else "\n".join(left))
    return out


def messages(rows, schemas):
    """(conv_id, turn, role, message, n_calls, n_linked) of (conv_id, turn, role, text) rows."""
    parsed = [tool_calls.parse(role, text, schemas) for _, _, role, text in rows]
    first = {}
    for i, (conv, turn, *_) in enumerate(rows):
        for call in parsed[i][1]:
            if conv is not None and call["id"] is not None:
                key = (turn, call["at"], call["name"] or "", call["arguments"], call["status"])
                if (conv, call["id"]) not in first or key < first[conv, call["id"]][0]:
                    first[conv, call["id"]] = (key, i, call)
    answer = {}
    for i, (conv, turn, *_) in enumerate(rows):
        if (own := first.get((conv, parsed[i][2]))) and parsed[i][2] is not None and turn > own[0][0]:
            found = (turn, parsed[i][0] is not None, parsed[i][0] or "", i)
            answer[conv, parsed[i][2]] = min(answer.get((conv, parsed[i][2]), found), found)
    level = {}
    while True:
        needs = {
            k: [(k[0], x) for x in call["needs"] if (k[0], x) in first] for k,
            (_, _, call) in first.items() if k not in level
        }
        ready = {
            k: 1 + max([level[n] for n in on], default=-1) for k, on in needs.items() if all(n in level for n in on)
        }
        if not ready:
            break
        level |= ready
    out = []
    for i, (conv, turn, role, _) in enumerate(rows):
        content, calls, answers = parsed[i]
        listed = []
        for call in calls:
            key = (conv, call["id"])
            own = conv is not None and call["id"] is not None and first[key][1] == i and first[key][2] is call
            got = answer.get(key) if own else None
            status = call["status"] if own or conv is None or call["id"] is None else "duplicate"
            body = {
                "arguments": call["arguments"], "id": call["id"], "name": call["name"],
                "result": rows and got and parsed[got[3]][0], "status": status
            }
            text = "{" + ",".join(
                f'"{k}":{v if k == "arguments" else tool_calls.canonical(v)}' for k, v in body.items()
            ) + "}"
            listed.append((level.get(key, 1 << 62) if own else 1 << 62, call["at"], text, got is not None))
        fields = [f'"content":{tool_calls.canonical(content)}', f'"role":{tool_calls.canonical(role)}']
        fields += [f'"tool_call_id":{tool_calls.canonical(answers)}'] if answers is not None else []
        fields += ['"tool_calls":[' + ",".join(x[2] for x in sorted(listed)) + "]"] if listed else []
        out.append((conv, turn, role, "{" + ",".join(fields) + "}", len(calls), sum(x[3] for x in listed)))
    return out
