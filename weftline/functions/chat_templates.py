"""Chat templates by model family, for functions.text.chat_prompt(). Further ones can be given as strings or as further entries."""

from __future__ import annotations

from collections.abc import Mapping

# The public prompt formats of model families.
TEMPLATES = {
    "plain": "{{system_prompt}}\n\n{{prompt}}",
    "llama2": "[INST] <<SYS>>\n{{system_prompt}}\n<</SYS>>\n\n{{prompt}} [/INST] ",
    "mistral": "[INST] {{prompt}} [/INST] ",
    "chatml": "<|im_start|>system\n{{system_prompt}}<|im_end|>\n<|im_start|>user\n{{prompt}}<|im_end|>\n<|im_start|>assistant\n",
    "zephyr": "<|system|>\n{{system_prompt}}</s>\n<|user|>\n{{prompt}}</s>\n<|assistant|>\n",
    "vicuna": "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions.\n\nUSER: {{prompt}}\nASSISTANT: ",
    "alpaca": "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n{{prompt}}\n\n### Response:\n",
    "instruction": "### Instruction:\n{{prompt}}\n\n### Response:\n",
    "orca": "### System:\n{{system_prompt}}\n\n### User:\n{{prompt}}\n\n### Assistant:\n",
    "user_assistant": "### User: {{prompt}}\n### Assistant: ",
    "guanaco": "### Human: {{prompt}}\n### Assistant: ",
    "olmo": "<|endoftext|><|user|>\n{{prompt}}\n<|assistant|>\n",
    "tulu": "<|user|>\n{{prompt}}\n<|assistant|>\n",
    "starchat": "<|system|>\n<|end|>\n<|user|>\n{{prompt}}<|end|>\n<|assistant|>\n",
    "oasst": "<|prompter|>{{prompt}}<|endoftext|><|assistant|>",
    "openchat": "GPT4 Correct User: {{prompt}}<|end_of_turn|>GPT4 Correct Assistant: ",
    "command_r": "<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{{prompt}}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>",
    "phi": "Instruct: {{prompt}}\nOutput: ",
    "falcon": "{{system_prompt}}\nUser: {{prompt}}\nAssistant: ",
    "stablelm": "<|SYSTEM|>{{system_prompt}}\n<|USER|>{{prompt}}<|ASSISTANT|>",
    "redpajama": "<human>: {{prompt}}\n<bot>: ",
    "koala": "BEGINNING OF CONVERSATION:\nUSER: {{prompt}}\nGPT: ",
    "metharme": "<|system|>{{system_prompt}}<|user|>{{prompt}}<|model|>",
    "solar": "### User:\n {{prompt}}\n\n### Assistant:\n",
    "baize": "{{system_prompt}}\n[|Human|]{{prompt}}\n[|AI|]",
    "internlm": "<|User|>:{{prompt}}<eoh>\n<|Bot|>:",
}
# Parts that a model's name has all of, and the family they tell, the first that fits.
FAMILIES = [
    (("codellama", "instruct"), "mistral"), (("llama-", "-2-", "-chat"), "llama2"), (("mistral-", "instruct"), "mistral"), (("mixtral-", "instruct"), "mistral"),
    (("stablelm", "zephyr"), "tulu"), (("stablelm", "tuned"), "stablelm"), (("zephyr-",), "zephyr"), (("tinyllama",), "zephyr"),
    (("yi-", "-chat"), "chatml"), (("qwen", "-chat"), "chatml"), (("dolphin-", "mistral"), "chatml"), (("orca-", "-2"), "chatml"), (("mpt-", "-chat"), "chatml"), (("openhermes",), "chatml"),
    (("nous-", "hermes"), "instruction"), (("olmo-", "instruct"), "olmo"), (("command-r",), "command_r"), (("phi-", "-2"), "phi"), (("openchat",), "openchat"), (("starling",), "openchat"),
    (("solar-", "instruct"), "solar"), (("stablebeluga",), "orca"), (("orca", "mini"), "orca"), (("falcon-", "-chat"), "falcon"), (("redpajama-", "-chat"), "redpajama"),
    (("wizardcoder",), "alpaca"), (("wizardmath",), "alpaca"), (("wizardlm",), "vicuna"), (("airoboros",), "vicuna"), (("vicuna",), "vicuna"), (("tulu",), "tulu"), (("starchat",), "starchat"),
    (("oasst",), "oasst"), (("openassistant",), "oasst"), (("gorilla",), "user_assistant"), (("koala",), "koala"), (("metharme",), "metharme"), (("baize",), "baize"),
    (("internlm-", "-chat"), "internlm"), (("guanaco",), "guanaco"), (("open-llama",), "alpaca"), (("camel",), "alpaca"), (("alpaca",), "alpaca"),
]


def template_for(model_name: str, further: Mapping[str, str] | None = None) -> str:
    """The template of a model by its name: of the further entries (part of a name -> template) first; 'plain' if none fits."""
    lower = model_name.lower()
    for part, template in (further or {}).items():
        if part.lower() in lower:
            return template
    return TEMPLATES[next((family for parts, family in FAMILIES if all(p in lower for p in parts)), "plain")]
