"""DataFrame operators over cards, history and decks."""
