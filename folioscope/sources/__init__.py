"""Tables, file trees, git trees and embedding providers."""
