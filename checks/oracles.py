"""The registered queries as plain SQL, by other means than the library's where there are any."""

from __future__ import annotations

import re

from checks.queries import DISTILS, MERGES, PROMPTS, REWRITES, SLICES

_NL = "chr(10)"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SEEDS = (
    "(0, 'Let''s think step by step.'), (1, 'Think about this logically.'), "
    "(2, 'Solve this problem by breaking it down into smaller parts.'), "
    "(3, 'Take a deep breath and work on this problem step-by-step.'), "
    "(4, 'Please provide a detailed explanation followed by the final answer.')"
)


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANK})"


def _number(x: str) -> str:
    return rf"try_cast(regexp_extract_all(replace({x}, ',', ''), '-?\d+\.?\d*')[-1] as double)"


def _loose(x: str) -> str:
    return f"upper(nullif(right(regexp_replace({x}, '[^A-Da-d]', '', 'g'), 1), ''))"


def _strict(source: str, text: str) -> str:
    """``source`` with the column ``letter``. Neighbours are matched, as there is no look-behind."""
    return rf"""
      select * exclude (low, phrase, tail, parens, words),
        upper(coalesce(nullif(regexp_extract({text}, '(?i)\\boxed\{{\s*([A-E])\s*\}}', 1), ''),
          case when phrase is null then coalesce(parens[-1], words[-1]) else coalesce(parens[1], words[1]) end,
          case when length({_strip(text)}) < 10 then nullif(regexp_extract({text}, '[A-Ea-e]'), '') end)) as letter
      from (select *, regexp_extract_all(tail, '\(([a-e])\)', 1) as parens,
          regexp_extract_all(' ' || regexp_replace(tail, '[^\p{{L}}\p{{N}}_]', '  ', 'g') || ' ', ' ([a-e]) ', 1) as words
        from (select *, case when phrase is null then low else string_split(low, phrase)[-1] end as tail
          from (select *, case when contains(low, 'answer is') then 'answer is' when contains(low, 'answer:') then 'answer:'
              when contains(low, 'option:') then 'option:' when contains(low, 'choice:') then 'choice:' end as phrase
            from (select *, lower({text}) as low from {source}))))"""


def _graded(source: str, letter: str = "letter") -> str:
    """Outcome of ``raw_output`` by type."""
    return f"""case when raw_output is null then 'failed'
      when coalesce(case when type = 'math' then abs({_number('raw_output')} - {_number('answer')}) < 1e-6
        when type = 'multiple_choice' then {letter} = upper(answer)
        else {_strip('raw_output')} = answer end, false) then 'correct' else 'wrong' end"""


def _repr(x: str) -> str:
    escaped = (rf"replace(replace(replace(replace({x}, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')")
    return (f"case when contains({x}, '''') and not contains({x}, '\"') then '\"' || {escaped} || '\"' "
            f"else '''' || replace({escaped}, '''', '\\''') || '''' end")


def _percent(c: str, n: str) -> str:
    h = f"(({c} * 20000 + {n}) // ({n} * 2))"
    return f"cast({h} // 100 as varchar) || '.' || lpad(cast({h} % 100 as varchar), 2, '0')"


def _asked(system: str, user: str) -> str:
    """The number that the fixed-answer models draw from a request."""
    return f"('0x' || left(md5({system} || {_NL} || {user}), 6))::bigint"


def _filled(template: str, **values: str) -> str:
    """Template with its places replaced, as one expression."""
    parts = re.split(r"(\{\w+\})", template)
    shown = [values[p[1:-1]] if p.startswith("{") else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
             for p in parts if p]
    return " || ".join(shown)


_DERIVED = {
    "fx_items": """select doc_id as item_id, source as subset, cast(floor(doc_id / 10) as bigint) % 4 as run_id,
      text as question,
      case doc_id % 10 when 0 then 'math' when 1 then 'general' else 'multiple_choice' end as type,
      case doc_id % 10 when 0 then cast(1000 + doc_id as varchar) when 1 then 'yes'
        else substring('ABCD', cast(doc_id % 4 as int) + 1, 1) end as answer from documents""",
    "fx_prompts": f"select * from (values {_SEEDS}) t(prompt_pos, prompt)",
    "fx_raw": """select source as subset, doc_id as pos, text as question, string_split(text, chr(10)) as c,
      doc_id % 6 - 1 as a from documents""",
    "fx_formatted": """select pos, subset, question || chr(10) || '(A) ' || c[1] || chr(10)
        || case when len(c) > 1 then '(B) ' || c[2] || chr(10) else '' end
        || case when len(c) > 2 then '(C) ' || c[3] || chr(10) else '' end
        || case when len(c) > 3 then '(D) ' || c[4] || chr(10) else '' end || 'Answer:' as question,
      case a when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D' end as answer from fx_raw""",
    "fx_outputs": """select run_id, item_id, subset, type, answer, prompt_pos, prompt,
        case when (item_id * 7 + prompt_pos) % 97 = 0 or item_id % 53 = 5 then null
          when type = 'math' then question || ' First 12, so the total is ' || given || '.'
          when type = 'general' then chr(10) || ' ' || given || case when given = answer then ' ' else question end
          when item_id % 5 = 0 then question || ' The answer is (' || given || '). Not (E).'
          when item_id % 5 = 1 then question || ' So ' || chr(92) || 'boxed{ ' || lower(given) || ' } it is'
          when item_id % 5 = 2 then question || ' Not (E), so finally (' || given || ')'
          when item_id % 5 = 3 then question || ' Answer: ' || given || ' rather than E'
          else question || ' ' || given || '.' end as raw_output
      from (select *, case when item_id % 9 = 2 or (item_id * 31 + prompt_pos * 17) % 10 < 3 + prompt_pos then answer
            when type = 'math' then '7' when type = 'general' then 'no'
            else substring('BCDA', cast(item_id % 4 as int) + 1, 1) end as given
          from fx_items cross join fx_prompts)""",
    "fx_read": _strict("fx_outputs", "raw_output"),
    "fx_graded": f"""select run_id, item_id, subset, type, answer, prompt_pos, prompt, raw_output,
      {_graded('fx_read')} as outcome, {_graded('fx_read', _loose('raw_output'))} as loose_outcome from fx_read""",
    "fx_outcomes": """select run_id, item_id, any_value(subset) as subset,
        list(prompt order by prompt_pos) filter (outcome = 'correct') as correct_prompts,
        list(prompt order by prompt_pos) filter (outcome = 'wrong') as wrong_prompts,
        count(*) filter (outcome = 'correct') as n_correct, count(*) filter (outcome = 'wrong') as n_wrong,
        count(*) filter (outcome = 'failed') as n_failed
      from fx_graded group by run_id, item_id""",
    "fx_accuracy": """select run_id, prompt_pos, prompt, count(*) filter (outcome = 'correct') as correct,
        count(*) as total, count(*) filter (outcome <> 'failed') as answered,
        count(*) filter (outcome = 'correct') / count(*) as accuracy,
        count(*) filter (outcome = 'correct') / nullif(count(*) filter (outcome <> 'failed'), 0) as accuracy_answered
      from fx_graded group by run_id, prompt_pos, prompt""",
    "fx_responses": """select run_id, item_id, case item_id % 4
        when 0 then '<BLOCK><THOUGHT>t</THOUGHT><REWRITE_BEGIN>' || chr(10) || 'Check ' || subset
          || '</REWRITE_END></BLOCK><REWRITE_BEGIN>Verify ' || question || '</REWRITE_END>'
        when 1 then '<REWRITE BEGIN>Loose form of ' || question || '</REWRITE END>'
        when 2 then 'No tags at all in ' || question
        else '<rewrite_begin> twice </rewrite_end><REWRITE_BEGIN>' || question || '</REWRITE_END><REWRITE_BEGIN>twice</REWRITE_END>'
        end as response from fx_items""",
    "fx_tags": f"""select run_id, item_id, unnest(t) as body, generate_subscripts(t, 1) - 1 as tag_pos
      from (select run_id, item_id, case when len(e) > 0 then e else l end as t from (select run_id, item_id,
        list_transform(regexp_extract_all(response, '(?is)<REWRITE_BEGIN>(.*?)</REWRITE_END>', 1), lambda x: {_strip('x')}) as e,
        list_transform(regexp_extract_all(response, '(?is)<REWRITE[ _]BEGIN>(.*?)</REWRITE[ _]END>', 1), lambda x: {_strip('x')}) as l
        from fx_responses))""",
    "fx_wrong": """select run_id, item_id, prompt, row_number() over (partition by run_id, item_id order by prompt_pos) - 1 as n
      from fx_graded where outcome = 'wrong'""",
    "fx_pairs": """select w.run_id, w.item_id, w.n as pair_pos, w.prompt as old_prompt, t.body as new_prompt
      from fx_wrong w join fx_tags t on w.run_id = t.run_id and w.item_id = t.item_id and w.n = t.tag_pos""",
    "fx_candidates": """select run_id, item_id, subset, type, answer, pair_pos, old_prompt, new_prompt,
        case when (item_id * 3 + pair_pos) % 41 = 0 then null when type = 'math' then question || ' So ' || given
          when type = 'general' then given || case when given = answer then '' else question end
          else question || ' Answer: (' || given || ')' end as raw_output
      from (select *, case when (item_id + pair_pos) % 3 > 0 then answer when type = 'math' then '7'
          when type = 'general' then 'no' else substring('BCDA', cast(item_id % 4 as int) + 1, 1) end as given
        from fx_pairs join fx_items using (run_id, item_id))""",
    "fx_candidates_read": _strict("fx_candidates", "raw_output"),
    "fx_tried": f"select *, {_graded('fx_candidates_read')} as outcome from fx_candidates_read",
    "fx_checked": """select p.*,
        exists (select 1 from fx_tried x where x.run_id = p.run_id and x.item_id = p.item_id
          and x.new_prompt = p.new_prompt and x.outcome = 'correct') as verified,
        (select max_by(raw_output, pair_pos) from fx_tried x where x.run_id = p.run_id and x.item_id = p.item_id
          and x.new_prompt = p.new_prompt and x.outcome = 'wrong') as last_wrong
      from fx_tried p""",
    "fx_status": """select o.run_id, o.item_id, o.subset as source, o.n_correct,
        case when n_wrong = 0 and n_correct = 0 then 'Failed (No Response)'
          when n_wrong = 0 then 'Skipped (All Correct)' when coalesce(n, 0) = 0 then 'Failed (Refine Step)'
          when v = 0 then 'Failed (Verification)' else 'Success' end as status,
        n_wrong as initial_wrong, coalesce(v, 0) as verified_success
      from fx_outcomes o left join (select run_id, item_id, count(*) as n, count(*) filter (verified) as v
        from fx_checked group by run_id, item_id) c on o.run_id = c.run_id and o.item_id = c.item_id""",
    "fx_failures": f"""select run_id, item_id, count(*) filter (outcome = 'wrong') as n_wrong,
        coalesce(string_agg('<CASE>' || {_NL} || 'Original Prompt: ' || prompt || {_NL} || 'Model Output: '
          || case when length(raw_output) > 300 then left(raw_output, 300) || '...' else raw_output end
          || {_NL} || '</CASE>', {_NL} order by prompt_pos) filter (outcome = 'wrong'), '') as case_block,
        '[' || coalesce(string_agg({_repr('prompt')}, ', ' order by prompt_pos) filter (outcome = 'correct'), '') || ']'
          as correct_list
      from fx_graded group by run_id, item_id having count(*) filter (outcome = 'wrong') > 0""",
    "fx_rules": """select conv_id * 100 + turn as item_id, conv_id % 4 as run_id,
        'Certainly!' || chr(10) || '[Guiding Tone]' || chr(10) || 'Authoritative' || chr(10) || chr(10)
        || '[Key Vocabulary]' || chr(10) || 'Clarity, ' || coalesce(string_split(text, ' ')[1], '') || ', Term '
        || coalesce(string_split(text, ' ')[5], '') || chr(10) || chr(10) || '[Thinking Steps]' || chr(10) || '1. ' || text
        || chr(10) || chr(10) || '---' || chr(10) || 'Done.' as rule_text
      from conversations""",
    "fx_placed": """select *, (row_number() over (partition by run_id order by item_id) - 1) // 3 as chunk,
        (row_number() over (partition by run_id order by item_id) - 1) % 3 + 1 as place from fx_rules""",
    "fx_chunks": """select run_id, chunk, count(*) as n_rules, max(item_id) as sample_idx, count(*) < 3 as is_tail,
        string_agg('Rule ' || cast(place as varchar) || ':' || chr(10) || rule_text, chr(10) || chr(10) order by place)
          as rules_block from fx_placed group by run_id, chunk""",
    "fx_sections": rf"""select run_id, item_id, h as heading, {_strip(r"regexp_replace(substr(rule_text, strpos(rule_text, '[' || h || ']') + length(h) + 3), '(?ms)(^\[(Guiding Tone|Key Vocabulary|Thinking Steps)\]|^-{3,}[ \t]*$).*', '')")}
        as body from fx_rules, (values ('Guiding Tone'), ('Key Vocabulary'), ('Thinking Steps')) t(h)""",
    "fx_generated": """select run_id, item_id, case item_id % 4
        when 0 then 'Here are the prompts:' || chr(10) || '1. Think about ' || subset || ' first' || chr(10)
          || 'short' || chr(10) || '2) Check each step twice' || chr(10) || question
        when 1 then '"Verify the final result"' || chr(10) || chr(10) || '''Explain every decision''' || chr(10) || question
        when 2 then question
        else '  Analyze the data. Then answer  ' || question end as response from fx_items""",
    "fx_updates": """select run_id, max(item_id) + 1 as valid_from from (select run_id, item_id,
          (row_number() over (partition by run_id order by item_id) - 1) // 3 as c from fx_items)
        group by run_id, c having count(*) = 3 and (valid_from % 5 <> 0 or valid_from % 3 <> 0)""",
    "fx_pools": """select run_id, cast(0 as bigint) as valid_from, prompt_pos, prompt
        from (select distinct run_id from fx_items), fx_prompts
      union all select run_id, valid_from, k, 'Pool ' || valid_from || ' prompt ' || k
        from fx_updates, (values (0), (1), (2)) t(k)""",
    "fx_starts": "select distinct run_id, valid_from from fx_pools",
    "fx_usage": """select event_id as call_id, ts, user_id % 4 as run_id,
        case when event_type in ('view', 'click') then 'scorer' else 'optimizer' end as role,
        case when event_type in ('view', 'click') then 'small:7b' else 'large:32b' end as model,
        cast(floor(value * 10) as bigint) as prompt_tokens, cast(floor(value * 25) as bigint) as completion_tokens
      from events""",
    "fx_cost": """select run_id, role, model, max(ts) as ended, sum(prompt_tokens)::bigint as input_tokens,
        sum(completion_tokens)::bigint as output_tokens, sum(prompt_tokens + completion_tokens)::bigint as total_tokens,
        (case when role = 'optimizer' then (sum(prompt_tokens) * 25 + sum(completion_tokens) * 100 + 50) // 100
          else 0 end) / 1e5 as est_cost from fx_usage group by run_id, role, model""",
    "fx_headers": """select run_id, '[''' || string_agg(distinct subset, ''', ''' order by subset) || ''']' as subjects,
        string_agg(distinct subset, ',' order by subset) as subsets, count(*) as n from fx_items group by run_id""",
    "fx_loose_accuracy": """select run_id, prompt_pos, prompt, count(*) filter (loose_outcome = 'correct') as correct,
        count(*) as total from fx_graded group by run_id, prompt_pos, prompt""",
    "fx_names": """select run_id, n, subsets, 'runs/small-7b-x_large-32b-x_MMLU_'
        || case when run_id = 0 then 'All' else cast(len(string_split(subsets, ',')) as varchar) || 'Sub' end
        || '_Lim' || case when run_id % 2 = 0 then n else -1 end
        || case when run_id % 2 = 0 then '_Base_0' else '_Iter_5' end
        || '_20251213-16' || lpad(cast(run_id as varchar), 2, '0') || '14' as path from fx_headers""",
    "fx_texts": """select 'output' as kind, item_id as id, cast(prompt_pos as bigint) as pos, raw_output as text from fx_outputs
      union all select 'document', doc_id, 0, text from documents
      union all select 'turn', conv_id, turn, text from conversations""",
    # The fixed-answer scorer over items and seed prompts.
    "fx_asked": f"""select *, {_asked("'You are a helpful assistant.'", "prompt || chr(10) || chr(10) || question")} as n
      from fx_items cross join fx_prompts""",
    "fx_called": """select *, case when n % 19 <> 7 then 'Of ' || n || ' the answer is ('
        || substring('ABCD', cast(n % 4 as int) + 1, 1) || ')' end as raw_output from fx_asked""",
    "fx_called_read": _strict("fx_called", "raw_output"),
    "fx_answers": f"select *, {_graded('fx_called_read')} as outcome from fx_called_read",
    "fx_improve_failures": f"""select run_id, item_id, any_value(question) as question, any_value(answer) as answer,
        count(*) filter (outcome = 'wrong') as n_wrong, count(*) filter (outcome = 'correct') as n_correct,
        coalesce(string_agg('<CASE>' || {_NL} || 'Original Prompt: ' || prompt || {_NL} || 'Model Output: ' || raw_output
          || {_NL} || '</CASE>', {_NL} order by prompt_pos) filter (outcome = 'wrong'), '') as case_block,
        '[' || coalesce(string_agg({_repr('prompt')}, ', ' order by prompt_pos) filter (outcome = 'correct'), '') || ']'
          as correct_list
      from fx_answers group by run_id, item_id""",
    "fx_improve_sizes": f"""select *, {_asked("replace(t.template, '{num}', cast(n_wrong as varchar))", """'[TASK CONTEXT]'
          || chr(10) || 'Question: ' || question || chr(10) || 'Ground Truth: ' || answer || chr(10) || chr(10)
          || '[FAILED PROMPTS & OUTPUTS]' || chr(10) || case_block || chr(10) || chr(10)
          || '[SUCCESSFUL PROMPTS (REFERENCE)]' || chr(10) || correct_list""")} as size
      from fx_improve_failures, fx_templates t""",
    "fx_improve_pairs": """select run_id, item_id, k as pair_pos, prompt as old_prompt,
        'Check part ' || k || ' of ' || size as new_prompt
      from (select s.run_id, s.item_id, s.size, s.n_wrong, w.prompt,
          row_number() over (partition by w.run_id, w.item_id order by w.prompt_pos) - 1 as k
        from fx_improve_sizes s join fx_answers w on s.run_id = w.run_id and s.item_id = w.item_id and w.outcome = 'wrong')
      where size % 5 <> 0 and k < n_wrong - size % 2""",
    "fx_improve_called": f"""select *, case when n % 19 <> 7 then 'Of ' || n || ' the answer is ('
        || substring('ABCD', cast(n % 4 as int) + 1, 1) || ')' end as raw_output
      from (select *, {_asked("'You are a helpful assistant.'", "new_prompt || chr(10) || chr(10) || question")} as n from fx_improve_pairs join fx_items using (run_id, item_id))""",
    "fx_improve_read": _strict("fx_improve_called", "raw_output"),
    "fx_improve_tried": f"select *, {_graded('fx_improve_read')} as outcome from fx_improve_read",
    "fx_improve_counts": """select run_id, item_id, count(*) as n, count(*) filter (outcome = 'correct') as v
      from fx_improve_tried group by run_id, item_id""",
    "fx_improve_rules": f"""select run_id, item_id, '[Key Vocabulary]' || chr(10) || 'clarity, size ' || size as rule_text
      from (select p.run_id, p.item_id, {_asked("""replace(any_value(t.rules), '{pairs_block}',
          string_agg('Original: ' || old_prompt || chr(10) || 'Improved: ' || new_prompt, chr(10) order by pair_pos))""",
          "'Correct Prompts:' || chr(10) || any_value(f.correct_list)")} as size
        from fx_improve_tried p join fx_improve_failures f using (run_id, item_id), fx_templates t
        where p.outcome = 'correct' group by p.run_id, p.item_id) where size % 7 <> 0""",
}


def _templates() -> str:
    from promptmill.functions import templates as tp
    quoted = ["'" + t.replace("'", "''") + "'" for t in (
        tp.REWRITE_TEMPLATE, tp.RULE_TEMPLATE, tp.MERGE_TEMPLATE, tp.GENERATE_TEMPLATE)]
    return "select {} as template, {} as rules, {} as merges, {} as prompts".format(*quoted)


_DERIVED["fx_templates"] = _templates()


def _with(body: str, recursive: str = "") -> str:
    """``body`` with the derived tables it needs, in order of need."""
    needed: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"\bfx_\w+", sql):
            if name in _DERIVED and name not in needed:
                need(_DERIVED[name])
                if name not in needed:
                    needed.append(name)
    need(recursive + body)
    parts = [f"{name} as materialized ({_DERIVED[name]})" for name in needed] + ([recursive] if recursive else [])
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def _slices() -> str:
    out = []
    for limit, offset in SLICES:
        upper = f" and r <= {offset + limit}" if limit > 0 else ""
        out.append(f"select {limit} as lim, {offset} as off, subset, item_id from (select subset, item_id, row_number() over "
                   f"(partition by subset order by item_id) as r from fx_items) where r > {offset}{upper}")
    return " union all ".join(out)


def _prompt_list(response: str) -> str:
    """Kept lines of a generation response, as a list."""
    lines = f"list_transform(string_split({response}, {_NL}), lambda x: {_strip('x')})"
    kept = f"list_filter({lines}, lambda x: length(x) > 10 and not starts_with(lower(x), 'here'))"
    bare = f"list_filter(list_transform({kept}, lambda x: trim(trim(x, '\"'), '''')), lambda x: x <> '')"

    def after(x: str, mark: str) -> str:
        return f"case when contains({x}, '{mark}') then {_strip(f'''substr({x}, strpos({x}, '{mark}') + 1)''')} else {x} end"
    dotted = f"list_transform({bare}, lambda x: case when regexp_matches(x, '^[0-9]') then {after('x', '.')} else x end)"
    # Whether a line was numbered is lost once its number is gone, so both forms go on together.
    both = f"list_transform({bare}, lambda x: struct_pack(num := regexp_matches(x, '^[0-9]'), t := x))"
    one = f"list_transform({both}, lambda s: struct_pack(num := s.num, t := case when s.num then {after('s.t', '.')} else s.t end))"
    return f"list_transform({one}, lambda s: case when s.num then {after('s.t', ')')} else s.t end)"


_IMPROVE_STATUS = """select a.run_id, a.item_id, i.subset as source,
    case when n_wrong = 0 and n_correct = 0 then 'Failed (No Response)' when n_wrong = 0 then 'Skipped (All Correct)'
      when coalesce(n, 0) = 0 then 'Failed (Refine Step)' when v = 0 then 'Failed (Verification)' else 'Success' end as status,
    n_wrong as initial_wrong, coalesce(v, 0) as verified_success,
    case when n_wrong > 0 and coalesce(n, 0) = 0 then 'No suggestions from optimizer'
      when n_wrong > 0 and v = 0 then 'All candidates failed' else '' end as note
  from fx_improve_failures a join fx_items i using (run_id, item_id) left join fx_improve_counts using (run_id, item_id)"""

_NOTE = """case status when 'Failed (Refine Step)' then 'No suggestions from optimizer'
  when 'Failed (Verification)' then 'All candidates failed' else '' end as note"""

# One step per Tier-1 merge: how many rules stand before it, and how many folds were made.
_STEPS = """steps as (
  select run_id, cast(0 as bigint) as t, cast(0 as bigint) as held, cast(0 as bigint) as folds from
    (select distinct run_id from fx_chunks)
  union all
  select s.run_id, s.t + 1, case when s.held + 1 = 3 then 1 else s.held + 1 end,
    case when s.held + 1 = 3 then s.folds + 1 else s.folds end
  from steps s join fx_chunks c on c.run_id = s.run_id and c.chunk = s.t and c.n_rules = 3),
ends as (select s.run_id, s.t as n_tier1, s.held, s.folds,
    (select count(*) from fx_chunks c where c.run_id = s.run_id and c.n_rules < 3) as n_tail
  from steps s where s.t = (select max(t) from steps z where z.run_id = s.run_id)),
ends_left as (select *, held + n_tail as n_left from ends)"""

_TREE = f"""
  select c.run_id, 'Tier-1' as tier, c.chunk + 1 as seq, cast(c.sample_idx as varchar) as sample_idx, c.n_rules as n_inputs,
    case when s.folds < e.folds then 'Recursive/Tier-N' when n_left > 1 then 'Convergence' end as parent_tier,
    case when s.folds < e.folds then s.folds + 1 when n_left > 1 then 1 end as parent_seq,
    case when s.folds < e.folds or n_left > 1 then s.held + 1 end as parent_place
  from fx_chunks c join steps s on c.run_id = s.run_id and c.chunk = s.t join ends_left e on c.run_id = e.run_id
  where c.n_rules = 3
  union all
  select c.run_id, 'Cleanup Tier-0', 1, cast(c.sample_idx as varchar), c.n_rules,
    case when n_left > 1 then 'Convergence' end, case when n_left > 1 then 1 end, case when n_left > 1 then n_left end
  from fx_chunks c join ends_left e on c.run_id = e.run_id where c.n_rules < 3
  union all
  select s.run_id, 'Recursive/Tier-N', s.folds + 1, cast(c.sample_idx as varchar), 3,
    case when s.folds + 1 < e.folds then 'Recursive/Tier-N' when n_left > 1 then 'Convergence' end,
    case when s.folds + 1 < e.folds then s.folds + 2 when n_left > 1 then 1 end,
    case when s.folds + 1 < e.folds or n_left > 1 then 1 end
  from fx_chunks c join steps s on c.run_id = s.run_id and c.chunk = s.t join ends_left e on c.run_id = e.run_id
  where c.n_rules = 3 and s.held = 2
  union all
  select run_id, 'Convergence', 1, 'FINAL', n_left, null, null, null from ends_left where n_left > 1"""


def _merging(rules: str) -> str:
    """Tables ``grown`` and ``final_rules``: neighbours merged level by level by the fixed-answer optimizer."""
    merged = """'[Guiding Tone]' || chr(10) || 'Calm' || chr(10) || chr(10) || '[Key Vocabulary]' || chr(10) || 'merged '
      || """ + _asked("""replace(any_value(merges), '{rules_block}', string_agg('Rule ' || cast(place as varchar) || ':' || chr(10)
        || rule_text, chr(10) || chr(10) order by place))""", "'Please fill the template based on the rules above.'")
    return f"""numbered as materialized (select run_id, rule_text, merges,
        row_number() over (partition by run_id order by item_id) - 1 as seq from {rules}, fx_templates),
      depth as (select coalesce(max(cast(ceil(ln(ceil((seq + 1) / 3)) / ln(3) - 1e-9) as int)), 0) as levels from numbered),
      grown as (
        select run_id, 0 as level, seq // 3 as seq, {merged} as rule_text, any_value(merges) as merges
        from (select *, seq % 3 + 1 as place from numbered) group by run_id, seq // 3
        union all
        select run_id, level + 1, seq // 3, case when count(*) = 1 then any_value(rule_text) else {merged} end, any_value(merges)
        from (select *, seq % 3 + 1 as place from grown where level < (select levels from depth))
        group by run_id, level, seq // 3),
      final_rules as (select run_id, rule_text from grown where level = (select levels from depth))"""


_FULL_RUN = f"""select f.run_id, f.rule_text, (select count(*) from grown g where g.run_id = f.run_id and level = 0) as n_merges,
    p.prompt_pos, p.prompt
  from final_rules f left join (select run_id, unnest(l) as prompt, generate_subscripts(l, 1) - 1 as prompt_pos from (
    select run_id, ['Think about ' || n || ' things', 'Verify all of the ' || n || ' parts', 'Explain step ' || n] as l
    from (select run_id, {_asked("replace(replace(prompts, '{num}', '8'), '{rules_block}', rule_text)", "'Please generate 8 new prompts based on the above rule now.'")} as n from final_rules, fx_templates)
    where n % 4 <> 1)) p on f.run_id = p.run_id"""

_BODIES = {
    "load_items": """select pos, question, answer, 'multiple_choice' as type, 'mmlu_' || subset as source from fx_formatted
      union all select item_id, text, text || ' #### ' || item_id, 'math', 'gsm8k' from benchmark
      union all select item_id, text, text || ' #### ' || item_id, 'general', 'unknown' from benchmark""",
    "held_out_items": """select pos, question, answer as ground_truth, 'multiple_choice' as type, subset as subject
      from fx_formatted where answer is not null""",
    "quarantined_items": "select pos, 'mmlu_' || subset as source from fx_formatted where answer is null",
    "format_question": "select pos, question, answer from fx_formatted",
    "load_counts": "select subset, count(*) as n_items from fx_items group by rollup (subset)",
    "subset_filter": """select subset, count(*) as n_items, 'all' as requested from fx_items
        where subset not in ('all', 'auxiliary_train') group by subset
      union all select subset, count(*), ' src1, src3 ,missing' from fx_items where subset in ('src1', 'src3', 'missing') group by subset
      union all select subset, count(*), '' from fx_items where subset = 'high_school_mathematics' group by subset""",
    "subset_slice": _slices(),
    "item_index": """select subset, item_id, row_number() over (order by subset, item_id) - 1 as item_index,
      count(*) over () as n_total from fx_items""",
    "head_tail_sample": """select * from (select row_number() over (order by subset, item_id) - 1 as item_index, item_id, subset,
      question from fx_items) where item_index < 10 or item_index >= (select count(*) from fx_items) - 10""",
    "prompt_item_cross": "select run_id, item_id, prompt_pos, prompt from fx_items cross join fx_prompts",
    "render_requests": """select item_id, prompt_pos, 'pool' as placement, 'You are a helpful assistant.' as system,
        prompt || chr(10) || chr(10) || question as user from fx_items cross join fx_prompts
      union all select item_id, prompt_pos, 'system', prompt, question from fx_items cross join fx_prompts""",
    "extract_number": f"select kind, id, pos, {_number('text')} as number from fx_texts",
    "extract_choice_strict": f"select kind, id, pos, letter as choice from ({_strict('fx_texts', 'text')})",
    "extract_choice_loose": f"select kind, id, pos, {_loose('text')} as choice from fx_texts",
    "grade_outputs": "select run_id, item_id, prompt_pos, type, outcome, loose_outcome from fx_graded",
    "answered_outputs": "select run_id, item_id, prompt_pos, raw_output, outcome from fx_graded where raw_output is not null",
    "grader_agreement": f"""select letter as strict, loose, count(*) as n from (select letter, {_loose('raw_output')} as loose
      from fx_read where type = 'multiple_choice' and raw_output is not null) group by letter, loose""",
    "item_outcomes": """select run_id, item_id, coalesce(array_to_string(correct_prompts, ' | '), '') as correct_prompts,
      coalesce(array_to_string(wrong_prompts, ' | '), '') as wrong_prompts, n_correct, n_wrong, n_failed from fx_outcomes""",
    "item_result_map": """select run_id, item_id, '{' || string_agg(to_json(prompt) || ':' || ok, ',' order by k, prompt_pos) || '}'
        as res from (select run_id, item_id, prompt_pos, prompt, 0 as k, outcome = 'correct' as ok from fx_graded
          where outcome <> 'failed'
        union all select run_id, item_id, prompt_pos, upper(prompt), 1,
          outcome = 'correct' and item_id % 2 = 1 from fx_graded where outcome <> 'failed' or item_id % 2 = 0)
      group by run_id, item_id""",
    "prompt_accuracy": "select * from fx_accuracy",
    "prompt_leaderboard": """select run_id, prompt_pos, accuracy, rank() over (partition by run_id order by accuracy desc) as rank,
      row_number() over (partition by run_id order by accuracy desc, prompt_pos) = 1 as is_best from fx_accuracy""",
    "eval_report_lines": f"""select run_id, block, unnest(l) as text, generate_subscripts(l, 1) - 1 as line from (
      select run_id, cast(0 as bigint) as block, string_split('Evaluation Report' || {_NL} || 'Model: small:7b' || {_NL}
        || 'Data Split: validation (Full)' || {_NL} || 'Subjects: ' || subjects || {_NL} || {_NL}, {_NL}) as l from fx_headers
      union all select run_id, prompt_pos + 1, string_split('Prompt #' || (prompt_pos + 1) || ' Accuracy: '
        || {_percent('correct', 'total')} || '% (' || correct || '/' || total || ')' || {_NL} || 'Prompt: ' || left(prompt, 100)
        || '...' || {_NL} || repeat('-', 30) || {_NL}, {_NL}) from fx_loose_accuracy)""",
    "eval_report_parse": f"""select run_id, prompt_pos + 1 as prompt_no, cast({_percent('correct', 'total')} as double) as percent,
      correct, total, left(prompt, 100) || '...' as label from fx_loose_accuracy""",
    "run_catalog": """select path, 'small-7b-x' as target_model, 'large-32b-x' as optimizer_model, 'MMLU' as dataset,
      case when run_id = 0 then 'All' else cast(len(string_split(subsets, ',')) as varchar) || 'Sub' end as subset_label,
      cast(case when run_id % 2 = 0 then n else -1 end as int) as "limit", case when run_id % 2 = 0 then 'Base' else 'Iter' end as mode,
      case when run_id % 2 = 0 then 0 else 5 end as prompt_count,
      '2025-12-13 16:' || lpad(cast(run_id as varchar), 2, '0') || ':14' as started,
      exists (select 1 from fx_prompts where length(prompt) > 30 + 15 * run_id) as has_prompts from fx_names""",
    "evaluable_runs": """select run_id, path from fx_names
      where exists (select 1 from fx_prompts where length(prompt) > 30 + 15 * run_id)""",
    "run_comparison": """select run_id // 2 as pair, max(m) filter (run_id % 2 = 0) as base_mean, max(m) filter (run_id % 2 = 1) as iter_mean,
        max(b) filter (run_id % 2 = 0) as base_best, max(b) filter (run_id % 2 = 1) as iter_best,
        max(m) filter (run_id % 2 = 1) - max(m) filter (run_id % 2 = 0) as mean_lift,
        max(b) filter (run_id % 2 = 1) - max(b) filter (run_id % 2 = 0) as best_lift
      from (select run_id, avg(accuracy) as m, max(accuracy) as b from fx_accuracy group by run_id) group by run_id // 2""",
    "evaluated_runs": """select n.run_id, path as run_path, avg(accuracy) as mean_accuracy, max(accuracy) as best_accuracy,
        arg_max(prompt, accuracy * 1000 - prompt_pos / 1000) as best_prompt
      from (select *, correct / total as accuracy from fx_loose_accuracy) a join fx_names n on a.run_id = n.run_id
      group by n.run_id, path""",
    "matched_runs": """select n.run_id, left(path, length(path) - 6) || '16' || lpad(cast(n.run_id // 2 as varchar), 2, '0') || '14' as run_path,
        avg(correct / total) as mean_accuracy, max(correct / total) as best_accuracy, cast(3 as bigint) as seconds_away
      from fx_loose_accuracy a join fx_names n on a.run_id = n.run_id group by n.run_id, path""",
    "stored_runs": """select substring(path, 6) as run_name, cast(no as int) as prompt_no, s.prompt, case when correct is not null then 'validation' end
        as split, correct, total
      from (select *, row_number() over (partition by run_id order by prompt_pos) as no from fx_names cross join fx_prompts
        where length(prompt) > 30 + 15 * run_id) s
      left join fx_loose_accuracy a on a.run_id = s.run_id and a.prompt_pos = s.prompt_pos and s.run_id % 2 = 0""",
    "failure_cases": "select * from fx_failures",
    "rewrite_requests": f"""select run_id, item_id, n_wrong, {_filled(REWRITES, num='cast(n_wrong as varchar)')} as system,
        '[TASK CONTEXT]' || {_NL} || 'Question: ' || question || {_NL} || 'Ground Truth: ' || answer || {_NL} || {_NL}
        || '[FAILED PROMPTS & OUTPUTS]' || {_NL} || case_block || {_NL} || {_NL} || '[SUCCESSFUL PROMPTS (REFERENCE)]' || {_NL}
        || correct_list as user from fx_failures join fx_items using (run_id, item_id)""",
    "extract_tags": "select item_id, tag_pos, body from fx_tags",
    "rewrite_pairs": "select * from fx_pairs",
    "verified_pairs": "select run_id, item_id, pair_pos, old_prompt, new_prompt from fx_checked where verified",
    "refinement_trace": """select run_id, item_id, pair_pos, subset as source, old_prompt as original_prompt,
      new_prompt as candidate_prompt, verified, coalesce(last_wrong, case when verified then 'Correct' else 'No Output' end)
      as model_output from fx_checked""",
    "status_table": f"select run_id, item_id, source, status, initial_wrong, verified_success, {_NOTE} from fx_status",
    "status_file": f"""select run_id, item_id as id, source, replace(status, 'Failed (No Response)', 'Skipped (All Correct)') as status,
      initial_wrong, verified_success, {_NOTE} from fx_status""",
    "status_funnel": """select source, status, count(*) as n_items, sum(initial_wrong)::bigint as initial_wrong,
        sum(verified_success)::bigint as verified_success, count(*) / case when grouping(source) = 1 then
          (select count(*) from fx_status) else (select count(*) from fx_status z where z.source = s.source) end as share
      from fx_status s group by rollup (source, status)""",
    "results_roundtrip": """select item_id as id, subset as source, i.type, question as q, res, i.run_id from fx_items i join (
        select run_id, item_id, '{' || string_agg(to_json(prompt) || ':' || (outcome = 'correct'), ',' order by prompt_pos) || '}' as res
        from fx_graded where outcome <> 'failed' group by run_id, item_id) using (run_id, item_id)""",
    "rule_requests": f"""select run_id, item_id, {_filled(DISTILS, pairs_block='p')} as system,
        'Correct Prompts:' || {_NL} || correct_list as user from fx_failures join (select run_id, item_id,
          string_agg('Original: ' || old_prompt || {_NL} || 'Improved: ' || new_prompt, {_NL} order by pair_pos) as p
          from fx_checked where verified group by run_id, item_id) using (run_id, item_id)""",
    "tier1_chunks": "select run_id, chunk, n_rules, sample_idx, rules_block, is_tail from fx_chunks",
    "merge_requests": f"""select run_id, chunk, {_filled(MERGES, rules_block='rules_block')} as system,
      'Please fill the template based on the rules above.' as user from fx_chunks""",
    "rule_sections": "select * from fx_sections",
    "rule_consensus": f"""select term, n_rules, dense_rank() over (order by n_rules desc) as rank from (
      select lower({_strip('t')}) as term, count(distinct item_id) as n_rules from (select item_id,
        unnest(string_split(body, ',')) as t from fx_sections where heading = 'Key Vocabulary') where {_strip('t')} <> '' group by 1)""",
    "rule_log_blocks": "select run_id, 'Sample ' || item_id as title, rule_text as body from fx_rules",
    "generation_requests": f"""select run_id, item_id, {_filled(PROMPTS, num="'8'", rules_block='rule_text')} as system,
      'Please generate 8 new prompts based on the above rule now.' as user from fx_rules""",
    "generated_prompts": f"""select run_id, item_id, unnest(l) as prompt, generate_subscripts(l, 1) - 1 as prompt_pos
      from (select run_id, item_id, list_slice({_prompt_list('response')}, 1, 8) as l from fx_generated)""",
    "prompt_file_lines": rf"""select doc_id, unnest(l) as prompt, generate_subscripts(l, 1) - 1 as prompt_pos from (
      select doc_id, list_transform(list_filter(list_transform(string_split(replace(text || {_NL} || {_NL} || '  \sss first'
        || chr(13) || {_NL} || chr(9) || text || ' ' || {_NL}, chr(13) || {_NL}, {_NL}), {_NL}), lambda x: {_strip('x')}), lambda x: x <> ''),
        lambda x: regexp_replace(x, '^\\s*', '')) as l from documents)""",
    "prompt_pool_asof": """select i.run_id, i.item_id, s.valid_from, p.prompt_pos, p.prompt from fx_items i
      asof join fx_starts s on i.run_id = s.run_id and i.item_id >= s.valid_from
      join fx_pools p on p.run_id = s.run_id and p.valid_from = s.valid_from""",
    "pool_intervals": """select run_id, valid_from, row_number() over (partition by run_id order by valid_from) - 1 as pool_no,
      lead(valid_from) over (partition by run_id order by valid_from) as valid_to from fx_starts""",
    "prompt_history": """select case when valid_from = 0 then 'initial_load' else 'iterative_update' end as event,
        greatest(valid_from - 1, 0) as sample_idx, string_agg(prompt, ' | ' order by prompt_pos) as prompts,
        case when valid_from > 0 then 'Tier-1' end as derived_from_rule_tier, cast(count(*) as int) as count, run_id
      from fx_pools group by run_id, valid_from""",
    "usage_running": """select call_id, run_id, role, sum(prompt_tokens) over w::bigint as prompt_so_far,
        sum(completion_tokens) over w::bigint as completion_so_far,
        sum(prompt_tokens + completion_tokens) over w::bigint as total_so_far
      from fx_usage window w as (partition by run_id, role order by ts, call_id rows unbounded preceding)""",
    "cost_report": "select run_id, role, model, input_tokens, output_tokens, total_tokens, est_cost from fx_cost",
    "cost_file": "select run_id, strftime(ended, '%Y-%m-%d %H:%M:%S') as ended, role, model, total_tokens, est_cost from fx_cost",
    "model_calls": """select item_id, prompt_pos, raw_output, case when raw_output is null then 3 else 1 end as tries,
        case when raw_output is null then 'RuntimeError: busy' end as error, case when raw_output is not null then n end as prompt_tokens,
        case when raw_output is not null then n % 10 end as completion_tokens from fx_called""",
    "iterative_pools": """select run_id, count(*) as n_items, cast(0 as bigint) as misplaced, cast(0 as bigint) as late
      from fx_items group by run_id""",
    "resumed_calls": """select item_id, prompt_pos, raw_output, case when raw_output is null then 3 else 1 end as tries,
        cast(1 as bigint) as n_calls from fx_called""",
    "held_out_runs": f"""select run_id, cast(prompt_pos - run_id + 1 as int) as prompt_no, count(*) filter (outcome = 'correct') as correct,
        count(*) as total, left(prompt, 100) || '...' as label
      from (select *, {_graded('x', _loose('raw_output'))} as outcome from (select *, case when n % 19 <> 7 then '  Of ' || n
          || ' the answer is (' || substring('ABCD', cast(n % 4 as int) + 1, 1) || ') ' end as raw_output
        from (select *, {_asked('prompt', 'question')} as n from fx_items cross join fx_prompts where run_id < 3 and prompt_pos >= run_id)))
      group by run_id, prompt_pos, prompt""",
    "evaluate_pool": """select run_id, item_id, coalesce(string_agg(prompt, ' | ' order by prompt_pos) filter (outcome = 'correct'), '')
        as correct_prompts, count(*) filter (outcome = 'correct') as n_correct, count(*) filter (outcome = 'wrong') as n_wrong,
        count(*) filter (outcome = 'failed') as n_failed from fx_answers group by run_id, item_id""",
    "held_out_evaluation": f"""select run_id, prompt_pos, prompt, count(*) filter (outcome = 'correct') as correct, count(*) as total,
        count(*) filter (outcome <> 'failed') as answered, count(*) filter (outcome = 'correct') / count(*) as accuracy,
        count(*) filter (outcome = 'correct') / nullif(count(*) filter (outcome <> 'failed'), 0) as accuracy_answered
      from (select *, {_graded('x', _loose('raw_output'))} as outcome from (select *, case when n % 19 <> 7 then '  Of ' || n
          || ' the answer is (' || substring('ABCD', cast(n % 4 as int) + 1, 1) || ') ' end as raw_output
        from (select *, {_asked('prompt', 'question')} as n from fx_items cross join fx_prompts)))
      group by run_id, prompt_pos, prompt""",
    "refine_and_verify": """select run_id, item_id, pair_pos, subset as source, old_prompt as original_prompt, new_prompt as candidate_prompt,
      outcome = 'correct' as verified, case outcome when 'correct' then 'Correct' when 'wrong' then raw_output else 'No Output' end
      as model_output from fx_improve_tried""",
    "improvement_status": _IMPROVE_STATUS,
    "extracted_rules": "select * from fx_improve_rules",
    "prompts_from_rules": f"""select run_id, item_id, unnest(l) as prompt, generate_subscripts(l, 1) - 1 as prompt_pos from (
      select run_id, item_id, ['Think about ' || n || ' things', 'Verify all of the ' || n || ' parts'] as l from (
        select run_id, item_id, {_asked("replace(replace(prompts, '{num}', '2'), '{rules_block}', rule_text)", "'Please generate 2 new prompts based on the above rule now.'")} as n from fx_rules, fx_templates)
      where n % 4 <> 1)""",
}


#: Rounds that the SQL of iterative runs plays; a run that fills more chunks would have items in none of them.
ROUNDS = 24


def _iterative() -> str:
    """Statuses of iterative runs, item by item under the pool in force: the tables of one pass, once a round.

    A round takes what a run has left under its pool, and counts up to the item that fills the chunk.
    """
    from checks.queries import ITERATIVE_GROUP
    parts, said = ["i0_pool as materialized (select run_id, cast(-1 as bigint) as after, prompt_pos, prompt from (select distinct run_id from fx_items) cross join fx_prompts)"], []

    def own(k: int, sql: str) -> str:
        return re.sub(r"\bfx_(called_read|called|answers|asked|improve_\w+)\b", rf"i{k}_\1", sql)
    for k in range(ROUNDS):
        asked = f"""select i.*, p.prompt_pos, p.prompt, {_asked("'You are a helpful assistant.'", "prompt || chr(10) || chr(10) || question")} as n
          from fx_items i join i{k}_pool p on i.run_id = p.run_id and i.item_id > p.after"""
        parts.append(f"i{k}_asked as materialized ({asked})")
        for name in ("called", "called_read", "answers", "improve_failures", "improve_sizes", "improve_pairs", "improve_called", "improve_read",
                     "improve_tried", "improve_counts", "improve_rules"):
            parts.append(f"i{k}_{name} as materialized ({own(k, _DERIVED[f'fx_{name}'])})")
        parts.append(f"""i{k}_chunk as materialized (select run_id, max(item_id) as last_item,
            string_agg('Rule ' || o || ':' || chr(10) || rule_text, chr(10) || chr(10) order by o) as block
          from (select *, row_number() over (partition by run_id order by item_id) as o from i{k}_improve_rules)
          where o <= {ITERATIVE_GROUP} group by run_id having count(*) = {ITERATIVE_GROUP})""")
        merged = _asked("replace(t.merges, '{rules_block}', block)", "'Please fill the template based on the rules above.'")
        parts.append(f"""i{k}_merged as materialized (select run_id, last_item, '[Guiding Tone]' || chr(10) || 'Calm' || chr(10) || chr(10)
            || '[Key Vocabulary]' || chr(10) || 'merged ' || {merged} as text from i{k}_chunk, fx_templates t)""")
        made = _asked("replace(replace(t.prompts, '{num}', '5'), '{rules_block}', text)", "'Please generate 5 new prompts based on the above rule now.'")
        parts.append(f"i{k}_made as materialized (select run_id, last_item, {made} as m from i{k}_merged, fx_templates t)")
        parts.append(f"""i{k + 1}_pool as materialized (select run_id, last_item as after, unnest(range(3))::int as prompt_pos,
            unnest(['Think about ' || m || ' things', 'Verify all of the ' || m || ' parts', 'Explain step ' || m]) as prompt from i{k}_made where m % 4 <> 1
          union all select run_id, last_item, p.prompt_pos, p.prompt from i{k}_made join i{k}_pool p using (run_id) where m % 4 = 1)""")
        parts.append(f"i{k}_status as materialized ({own(k, _IMPROVE_STATUS)})")
        said.append(f"""select s.*, asked from i{k}_status s join (select run_id, item_id, string_agg(prompt, ' | ' order by prompt_pos) as asked
            from i{k}_asked group by run_id, item_id) using (run_id, item_id) left join i{k}_chunk c on c.run_id = s.run_id
          where c.run_id is null or s.item_id <= c.last_item""")
    body = " union all ".join(said)
    head = _with("select 1 from fx_items, fx_prompts, fx_templates").rpartition("\n")[0]
    return head + ",\n" + ",\n".join(parts) + "\n" + body


def oracles() -> dict[str, str]:
    out = {name: _with(body) for name, body in _BODIES.items()}
    # A stream gives what its batch twin gives.
    for stream, twin in (("stream_graded_outputs", "graded_rows"), ("stream_tier1_chunks", "tier1_chunks"),
                         ("stream_usage_cost", "cost_report"), ("run_files", "improvement_status"),
                         ("published_runs", "improvement_status")):
        out[stream] = out[twin] if twin in out else _with(
            "select run_id, item_id, prompt_pos, raw_output, outcome from fx_graded")
    out["merge_tree"] = _with(_TREE, _STEPS)
    out["merged_rules"] = _with("select * from final_rules", _merging("fx_rules"))
    out["full_run_iterative"] = out["stream_improvement"] = _iterative()
    out["full_run"] = _with(_FULL_RUN, _merging("fx_improve_rules"))
    return out
