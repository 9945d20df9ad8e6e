"""DataFrame operators: mining, dictionaries, substitution, conversations, prompts, reports."""
