"""Page content: operators, fonts, text runs and layout."""
